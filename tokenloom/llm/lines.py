"""Line dedup by content-defined chunks of lines, native DataFrame functions only.

A rolling hash over the hashes of two successive lines is taken at each line; a chunk ends after a line
whose rolling hash is smaller than its neighbours'. So boundaries depend on nearby lines alone and come
back wherever the same lines come back, and chunks hold two lines at least. Chunks of several lines that
occur more than once anywhere are compared byte for byte with their first occurrence, which stays; the
others are removed. A repeated passage goes where it holds a whole chunk: shorter ones, and passages
within a line, are not what this finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import cut

#: Of the rows of chunks, the share above which a hash is joined apart is one in so many.
HOT = 2000
#: Bits that are broadcast to tell documents without repeated chunks, at most (64 MB).
MOST_BITS = 1 << 29


def chunked(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds chunks: array<struct<text, eligible>> whose texts, joined by newlines, are the text; chunks of
    one line, and blank ones, are not eligible.

    Each step is a column that the next uses more than once, so none is worked out twice; no function
    of an element refers to another array, so the work is linear in the text.
    """
    blank, n = F.lit(""), F.size("_lines")
    lines = F.split(F.coalesce(F.col(text), blank), "\n", -1)
    df = docs.withColumn("_lines", lines).withColumn("_hashes", F.transform("_lines", lambda x: F.md5(x.cast("binary"))))

    def shifted(c: str, by: int) -> Column:
        return F.slice(F.concat(F.array(*[blank] * by), F.col(c)), F.lit(1), n)

    df = df.withColumn("_rolling", F.zip_with("_hashes", shifted("_hashes", 1), lambda h, before: F.md5(F.concat(h, before).cast("binary"))))
    near = F.arrays_zip(F.col("_lines").alias("line"), shifted("_rolling", 2).alias("a"), shifted("_rolling", 1).alias("b"), F.col("_rolling").alias("c"))

    def tagged(x: Column, i: Column) -> Column:
        starts = (i >= 2) & (i < n - 1) & (x["b"] < x["a"]) & (x["b"] <= x["c"])
        return F.concat(F.when(starts, "=").otherwise("+"), x["line"])

    # every newline is followed by a tag now, so "newline, =" is found at the chunks' starts only
    joined = F.array_join(F.transform(near, tagged), "\n")
    chunks = F.split(F.substring(joined, F.lit(2), F.length(F.coalesce(F.col(text), blank)) * 2 + 2), "\n=", -1)

    def described(c: Column) -> Column:
        own = F.replace(c, F.lit("\n+"), F.lit("\n"))
        return F.struct(own.alias("text"), (F.contains(c, F.lit("\n+")) & (F.ltrim(own, F.lit(" \t\r\n\x0b\f")) != "")).alias("eligible"))

    return df.withColumn("chunks", F.transform(chunks, described)).drop("_lines", "_hashes", "_rolling")


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def repeated_by_hash(keyed: DataFrame, hash_bits: int) -> DataFrame:
    """keyed (_id, _key, text) -> (_id, _key, found array<struct<number, hash, first>>) of the documents
    that hold a chunk whose hash occurs elsewhere. Texts stay where they are; only hashes are shuffled.

    Occurrences are ordered by _id (null first), _key and number.
    """
    rows = chunked(keyed).select("_id", "_key", F.posexplode(F.transform("chunks", lambda x: F.when(x["eligible"], F.xxhash64(x["text"]) % (1 << hash_bits)))).alias("number", "hash"))
    rows, _ = cut(rows.filter("hash IS NOT NULL"))
    at = F.struct("_id", "_key", "number")
    seen = rows.groupBy("hash").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n")).filter("NOT first <=> last")
    seen, _ = cut(seen.select("hash", "first", "n"))
    # a hash of over a HOT-th of the rows is joined by broadcast (there are at most HOT of them), the others by key
    often = F.col("n") > rows.count() / HOT
    hot, rare = seen.filter(often).select("hash", "first"), seen.filter(~often).select("hash", "first")
    found = rows.join(F.broadcast(hot), "hash").unionByName(rows.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(rare.hint("merge"), "hash"))
    return found.groupBy("_id", "_key").agg(F.collect_set(F.struct("number", "hash", (at.eqNullSafe(F.col("first"))).alias("first"))).alias("found"))


def own_columns(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("removed_lines", "removed_chunks")]


def place(bits: int) -> Column:
    return F.pmod(F.xxhash64("_id", "_key"), F.lit(bits))


def with_maybe(base: DataFrame, found: DataFrame) -> DataFrame:
    """base with _maybe: whether it may be one of found, by one bit of a hash of its key; never false for one.

    The bits are rows of 4 KB, and at most MOST_BITS of them are broadcast, about 16 for each of found while
    these are few. With very many more, more rows are a maybe and are shuffled for nothing, at worst all.
    """
    bits = 1 << 15
    while bits < min(16 * found.count(), MOST_BITS):
        bits *= 2
    set_bits = found.select(place(bits).alias("bit")).groupBy(F.shiftright("bit", 15).alias("_row_of_bits")).agg(F.bitmap_construct_agg(F.col("bit") % (1 << 15)).alias("_bits"))
    held = base.withColumn("_bit", place(bits)).withColumn("_row_of_bits", F.shiftright("_bit", 15)).join(F.broadcast(set_bits), "_row_of_bits", "left")
    at = (F.col("_bit") % (1 << 15)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return held.withColumn("_maybe", F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))).drop("_bit", "_row_of_bits", "_bits")


def marked(base: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """base (_row, _id, _key) with gone: the numbers of the chunks that occur before."""
    right = found.select(F.col("_id").alias("_i"), F.col("_key").alias("_k"), "found")
    joined = base.join(right.hint("merge"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left").drop("_i", "_k")
    joined, _ = cut(joined)
    held = joined.filter("found IS NOT NULL").select("_id", "_key", "found", F.col(f"_row.{text}").alias("text"))
    some = chunked(held).select("_id", "_key", F.explode(F.transform("found", lambda x: F.struct(x["number"].alias("number"), x["hash"].alias("hash"), x["first"].alias("first"), F.get("chunks", x["number"])["text"].alias("bytes")))).alias("c")).select("_id", "_key", "c.*")
    kinds = some.groupBy("hash", "bytes").agg(F.min(F.struct("_id", "_key", "number")).alias("first"))
    clashes, _ = cut(kinds.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"))
    if not clashes.isEmpty():
        # their own first occurrences stay, too
        kept = kinds.join(clashes, "hash").select("first.*").distinct()
        kept = kept.groupBy(F.col("_id").alias("_i"), F.col("_key").alias("_k")).agg(F.collect_set("number").alias("kept"))
        joined = joined.join(kept, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left").drop("_i", "_k")
    else:
        joined = joined.withColumn("kept", F.lit(None).cast("array<int>"))
    gone = F.transform(F.filter("found", lambda x: ~x["first"]), lambda x: x["number"])
    return joined.withColumn("gone", F.coalesce(F.array_except(gone, F.coalesce("kept", F.array().cast("array<int>"))), F.array().cast("array<int>")))


def dedup_lines(docs: DataFrame, text: str = "text", hash_bits: int = 62) -> DataFrame:
    """docs with repeated chunks removed from text, plus removed_lines and removed_chunks.

    Null and empty texts stay as they are and count for nothing; blank chunks, and chunks of one line, are
    never removed. Rows that repeat doc_id and text are one document: what the first occurrence keeps, all
    of them keep. Other columns stay; removed_lines and removed_chunks are replaced. An empty table gives
    no rows; very long texts take time in proportion to their length.

    Chunks are found by hash. Documents without a repeated chunk are told by a bitmap and stay where they
    are; the others are joined to their chunks, the one shuffle of texts, and the bytes of the chunks of
    each hash are compared. Where they differ (a clash of hashes), the chunks of that hash are worked out
    again by their bytes.
    """
    own = own_columns(docs)
    # documents ride in a struct, so that no column of theirs can clash with the working ones
    base = docs.select(F.struct(*own).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_key"), F.col(text).alias("text"))
    found, _ = cut(repeated_by_hash(base.filter(F.contains("text", F.lit("\n"))).select("_id", "_key", "text"), hash_bits))
    base = with_maybe(base.drop("text"), found)
    rest = base.filter(~F.col("_maybe")).select("_row.*", F.lit(0).alias("removed_lines"), F.lit(0).alias("removed_chunks"))
    joined = marked(base.filter("_maybe").select("_row", "_id", "_key"), found, text)
    split = chunked(joined.withColumn("_text", F.when(F.size("gone") > 0, F.col(f"_row.{text}"))), "_text")
    left = F.filter("chunks", lambda x, i: ~F.array_contains(F.col("gone"), i))
    removed = F.filter("chunks", lambda x, i: F.array_contains(F.col("gone"), i))
    touched = F.size("gone") > 0
    new = F.when(touched, F.array_join(F.transform(left, lambda x: x["text"]), "\n")).otherwise(F.col(f"_row.{text}"))
    lines = F.when(touched, F.aggregate(removed, F.lit(0), lambda a, x: a + line_count(x["text"]))).otherwise(0)
    done = split.select(*[new.alias(c) if c == text else F.col(f"_row.{c}").alias(c) for c in own], lines.alias("removed_lines"), F.size("gone").alias("removed_chunks"))
    return rest.unionByName(done)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(dedup_lines(read_table(spark, sf_dir, "documents", "doc_id", "text")))


def summary(out: DataFrame) -> DataFrame:
    return out.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("kept_chars"), F.col("removed_lines").cast("long").alias("removed_lines"), F.col("removed_chunks").cast("long").alias("removed_chunks"))


def lines_sql(table: str, keys: str) -> str:
    """CTEs from `table` (doc_id, text) up to line_dedup (doc_id, text_key, new_text, ...); DuckDB."""
    return rf"""
a AS (SELECT DISTINCT doc_id, text FROM {table}),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, list_transform(string_split(text, chr(10)), lambda x: md5(x)) AS h FROM a),
r AS (SELECT doc_id, text, ls, len(ls) AS n, list_transform(range(1, len(ls) + 1), lambda i: md5(h[i] || CASE WHEN i > 1 THEN h[i - 1] ELSE '' END)) AS rh FROM l),
e AS (SELECT doc_id, text, ls, list_filter(range(1, n + 1), lambda i: i = n OR (i >= 2 AND i < n - 1 AND rh[i] < rh[i - 1] AND rh[i] <= rh[i + 1])) AS ends FROM r),
x AS (SELECT doc_id, text, ls, ends, unnest(range(1, len(ends) + 1)) AS i FROM e),
c AS (SELECT doc_id, text, i - 1 AS number, ends[i] - CASE WHEN i > 1 THEN ends[i - 1] ELSE 0 END AS n_lines,
  array_to_string(ls[CASE WHEN i > 1 THEN ends[i - 1] ELSE 0 END + 1 : ends[i]], chr(10)) AS chunk FROM x),
o AS (SELECT *, n_lines > 1 AND trim(chunk, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' AS eligible FROM c),
d AS (SELECT *, eligible AND row_number() OVER (PARTITION BY eligible, chunk ORDER BY doc_id, number) > 1 AS gone FROM o),
line_dedup AS (SELECT doc_id, text, coalesce(string_agg(chunk, chr(10) ORDER BY number) FILTER (NOT gone), '') AS new_text,
  coalesce(sum(n_lines) FILTER (gone), 0)::BIGINT AS removed_lines, count(*) FILTER (gone) AS removed_chunks FROM d GROUP BY doc_id, text)"""


OP5_SQL = f"""WITH {lines_sql("documents", "doc_id")}
SELECT doc_id, md5(new_text) AS text_md5, length(new_text) AS kept_chars, removed_lines, removed_chunks
FROM documents JOIN line_dedup USING (doc_id, text)"""

import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tokenloom.llm import simhash as sh
from tokenloom.llm import topk
from tokenloom.llm.common import components

DOCS = "doc_id long, text string"


def by_hand(text, k=3):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(fp, radius):
    comp = list(range(len(fp)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return [find(i) for i in range(len(fp))]


@pytest.mark.parametrize("text", ["", None, "One", "one TWO", "a b c d e f g", "É é\x0bZ\u00a0z", "x " * 9000, "a\u2003b c"])
def test_fingerprint(text):
    assert int.from_bytes(sh.fingerprint(text, 3), "big") == by_hand(text)


def test_spark_hash_agrees(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_op2_by_hand(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    fp = [by_hand(r["text"]) for r in rows]
    want = {r["doc_id"]: (f"{x:016x}", rows[c]["doc_id"]) for r, x, c in zip(rows, fp, classes(fp, 3))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in sh.op2_simhash_near_dedup(spark, sf_dir).collect()} == want


def fp_frame(spark, fps):
    return spark.createDataFrame([(i, int(x).to_bytes(8, "big")) for i, x in enumerate(fps)], "node long, fp binary")


@pytest.mark.parametrize("block", [8192, 20])
def test_links_lose_nothing(spark, block):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(300)}
    centre = rng.getrandbits(64)
    for _ in range(150):  # a dense ball, in very full buckets
        x = centre
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    for x in list(fps)[:80]:
        y = x
        for b in rng.sample(range(64), rng.randint(1, 4)):
            y ^= 1 << b
        fps.add(y)
    fps = sorted(fps)
    e = sh.links(fp_frame(spark, fps), sh.SimHash(block=block))
    pairs = e.collect()
    assert all((fps[r["u"]] ^ fps[r["v"]]).bit_count() <= 3 for r in pairs) and len(pairs) < 4 * len(fps) * (1 if block > 100 else 20)
    got = {r["node"]: r["component"] for r in components(e).collect()}
    want = classes(fps, 3)
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(7, 7), (500, 400), (400, 500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(1, 40)} == {1} and got[500] == got[400] == 400
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edges_of_input(spark):
    rows = [(5, "a b c d"), (3, "A B C D"), (3, "A B C D"), (9, None), (8, ""), (None, "a b c d"), (None, "zzz yy"), (4, "quite another text here")]
    df = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit(1)).withColumn("node", F.lit("x"))
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in sh.near_duplicates(df).collect() if r["component_id"] is not None)
    assert got == [(-1, 3), (3, 3), (3, 3), (4, 4), (5, 3), (8, 8), (9, 8)]
    assert sh.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    kept = sh.drop_near_duplicates(df, sh.SimHash())
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, -1, 3, 4, 8]


def test_wide_fingerprints_find_near_copies(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, n = [], 60
    for i in range(n):
        w = [word() for _ in range(rng.randint(150, 400))]
        rows.append((i, " ".join(w)))
        for k in rng.sample(range(len(w)), len(w) // 60):
            w[k] = word()
        rows.append((1000 + i, " ".join(w)))
    p = sh.SimHash.for_similarity(0.8)
    got = {r["doc_id"]: r["component_id"] for r in sh.near_duplicates(spark.createDataFrame(rows, DOCS), p).collect()}
    assert all(got[i] == i for i in range(n)) and sum(got[1000 + i] == i for i in range(n)) >= 0.95 * n
    assert p.recall(0.1) > 0.9 and p.expected_recall(0.9) > 0.99 and sh.SimHash().recall(0.05) == 1.0


VECTORS = "vec_id long, embedding array<float>"


def best_by_hand(rows, k):
    """Every row against every other one, repeated ids too."""
    v = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in x]) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for at, (i, x) in enumerate(v):
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), j) for other, (j, y) in enumerate(v) if other != at)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "clustered", "ties", "few"])
def test_top_k_by_hand(spark, kind):
    rng = np.random.default_rng(2)
    n, d = {"few": (5, 3)}.get(kind, (900, 8))
    x = rng.normal(size=(n, d))
    if kind == "clustered":
        x = rng.normal(size=(12, d))[rng.integers(0, 12, n)] * 3 + rng.normal(size=(n, d)) * 0.01
    if kind == "ties":
        x = np.round(rng.normal(size=(n, d)))
        x[::3] = x[0]
    rows = [(i, [float(np.float32(c)) for c in r]) for i, r in enumerate(x)]
    rows += [(700, [float("nan")] * d), (100_000, None), (None, rows[0][1]), (200_000, [None] * d), (300_000, [float("inf")] * d), (rows[3][0], rows[3][1]), (400_000, []), (500_001, [1.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("rank", F.lit("clash")).withColumn("v", topk.whole_numbers(F.col("embedding")))
    got = sorted(tuple(r) for r in topk.top_k(df.select("vec_id", "v"), F.col("vec_id") % 100 == 0, 10).collect())
    assert got == best_by_hand(rows, 10)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0]), (1, [2.0]), (1, [5.0]), (1, [5.0]), (0, [3.0]), (0, [3.0])]
    df = spark.createDataFrame(rows, VECTORS).select("vec_id", topk.whole_numbers(F.col("embedding")).alias("v"))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, 3).collect())
    assert got == best_by_hand(rows, 3) and [r[2:] for r in got if r[1] == 1] == [(1, 5 * 1024 * x * 1024) for x in (1, 3, 3)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [list(r) for r in rows])
    assert sorted(con.sql(topk.OP3_SQL.replace("<= 10", "<= 3")).fetchall()) == got


def test_top_k_in_blocks_and_empty(spark, monkeypatch):
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.col("id") * 3 % 17, F.col("id") * 5 % 13).alias("v"))
    one = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0, 4).collect()))
    monkeypatch.setattr(topk, "BLOCK_BYTES", 500)
    monkeypatch.setattr(topk, "TREE", 7)
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0, 4).collect())) == one and len(one) == 120
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0, 4).count() == 0
    big = spark.createDataFrame([(0, [1 << 40, 1]), (1, [1 << 40, 0]), (2, [5, 1 << 30])], "vec_id long, v array<long>")
    assert [tuple(r) for r in topk.top_k(big, F.col("vec_id") == 0, 1).collect()] == [(0, 1, 1, (1 << 63) - 1)]


def test_pruning_happens():
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(20, 6))[rng.integers(0, 20, 4000)] * 3000 + rng.normal(size=(4000, 6)) * 5).astype(np.int64)
    s = topk.Search(np.arange(40), x[:40], 10)
    s.add(np.arange(4000), np.arange(4000), x)
    assert s.work < 0.5 * 40 * 4000  # bounds of centres count, too

"""Batches are encoded in portions of bounded size, with the same results as piece by piece."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.functions import byte_level
from tokenloom.functions import bytechars as bc
from tokenloom.functions.draws import first_draws
from tokenloom.functions.regex_compat import GPT2
from tokenloom.operators import decode as dc
from tokenloom.operators import pretokenize as pt
from tokenloom.operators.encode import PORTION, SHOWN, Words, encode, encode_pieces, portions
from tokenloom import queries as q
from tokenloom.operators.model import Bpe, merge, merge_with_dropout
from tokenloom.queries import fixed_model
from tokenloom.sources.tables import IN_PARTS, SMALL_READ, in_parts

SPLIT = regex.compile(GPT2)


def written(chars: int, seed: int = 0) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(["the", " reading", " then", " é", " ", "\n", " 12", ",", " " + "".join(rng.choices("aenrst", k=6)), "en" * 30]) for _ in range(chars // 4))[:chars]


def by_hand(text: str, model: Bpe) -> list[tuple[int, int]]:
    out = []
    for p in SPLIT.findall(text):
        out += [(i, len(model.tokens[i])) for i, _ in model.encode(bc.map_bytes(p.encode()))]
    return out


def given_rows(texts: list[str]) -> pa.StructArray:
    pieces = [SPLIT.findall(t) for t in texts]
    many = lambda f: pa.array([[f(p) for p in row] for row in pieces], pa.list_(pa.int32()))
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), many(lambda p: len(p.encode())), many(lambda p: 0)], ["text", "sizes", "marks"])


def test_portions_hold_all_rows_in_order():
    sizes = [10, 0, 90, 300, 1, None, 99, 100, 0, 5]
    texts = pa.array([None if n is None else "x" * n for n in sizes])
    got = list(portions(texts, 100))
    assert [at for at, _ in got] == np.cumsum([0] + [n for _, n in got])[:-1].tolist() and sum(n for _, n in got) == len(sizes)
    assert all(n == 1 or sum(x or 0 for x in sizes[at : at + n]) <= 100 for at, n in got) and len(got) == 5
    assert list(portions(pa.array([], pa.string()), 100)) == []


@pytest.mark.parametrize("dropout", [None, 0.5, 1.0])
def test_a_batch_takes_the_memory_of_a_portion(dropout):
    """As a whole, the 12 MB would take over 500 MB."""
    rows = pa.concat_arrays([given_rows([written(50_000, i) for i in range(40)])] * 6)
    words, most = Words(fixed_model(dropout=dropout), True, 1000, True), 0
    if dropout == 0.5:
        rows = rows.slice(0, 22)
    tracemalloc.start()
    for at, n in portions(rows.field("text")):
        part = rows.slice(at, n)
        out = words.one_by_one(part, list(range(n))) if dropout == 0.5 else words.batch(part)
        most = max(most, len(out.field("ids").flatten()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) > n and most <= PORTION and peak < 250e6


@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=8), st.dictionaries(st.tuples(st.integers(0, 6), st.integers(0, 6)), st.integers(4, 6), max_size=10))
def test_all_words_at_once(words, table):
    """Merges in any order of rank, empty words, words over the limit of short ones."""
    ranked = {p: (r, new) for r, (p, new) in enumerate(table.items())}
    model = Bpe({str(i): i for i in range(7)})
    model.__dict__["table"] = ranked
    symbols, lengths = np.array([i for w in words for i in w], np.int32), np.array([len(w) for w in words], np.int32)
    for dense in (True, False):
        if not dense:
            model.pairs.dense = None
        ids, sizes, many = model.pairs.merge_all(symbols, lengths, ranked)
        got = np.split(np.stack([ids, sizes], 1), np.cumsum(many)[:-1]) if len(words) else []
        assert [list(map(tuple, x.tolist())) for x in got] == [merge([(i, 1) for i in w], ranked) if w else [] for w in words]


@pytest.fixture(scope="module")
def long_rows(spark):
    """Over several portions in one task; a row longer than a portion, a null, empty ones."""
    texts = [written(40_000, i) for i in range(40)] + [None, "", written(PORTION + 100_000, 99), "", "the end"]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).cache()


def test_ids_and_offsets_over_portions(long_rows):
    texts, df = long_rows
    model = fixed_model()
    rows = encode(df, "text", model, pt.ByteLevel(False)).select("doc_id", "encoding.ids", "encoding.ends")
    got = {r["doc_id"]: r for r in rows.collect()}
    for i, t in enumerate(texts):
        want = by_hand(t or "", model)
        assert got[i]["ids"] == [x for x, _ in want] and got[i]["ends"] == np.cumsum([n for _, n in want]).astype(int).tolist()


def count(i: int, text: str) -> tuple:
    return (len(by_hand(text, fixed_model())),)


def halved(i: int, text: str) -> tuple:
    m = fixed_model(dropout=0.5)
    words = [m.symbols(bc.map_bytes(p.encode())) for p in SPLIT.findall(text)]
    return (sum(len(merge_with_dropout(w, m.table, 0.5, random.Random(f"{i}:{k}"))) for k, w in enumerate(words)),)


def digested(i: int, text: str) -> tuple:
    m = fixed_model()
    tokens = [m.tokens[x] for x, _ in by_hand(text, m)]
    return len(tokens), hashlib.md5("\x01".join(tokens).encode()).hexdigest()


def led(compat: bool):
    def offsets(i: int, text: str) -> tuple:
        m, put, at, out = fixed_model(), int(not text.startswith(" ")), 0, []
        for k, p in enumerate(SPLIT.findall(" " * put + text)):
            by = 0 if compat and k == 0 else put
            for t, _ in m.encode(bc.map_bytes(p.encode())):
                n = len(m.tokens[t])
                out.append(f"{max(at - by, 0)}-{max(at + n - by, 0)}")
                at += n
        return (hashlib.md5(" ".join(out).encode()).hexdigest(),)

    return offsets


#: What a query gives for a document, besides its id, found piece by piece.
HAND = {
    "encode_dropout_half": halved,
    "encode_offsets_prefix": led(False),
    "encode_offsets": lambda i, t: (len(t.encode()) or None,),
    "encode_fixed_merges": digested,
    "encode_decode_roundtrip": lambda i, t: (t,),
    "decode_ids": lambda i, t: (t,),
    "model_io_roundtrip": count,
    "encode_offsets_compat": led(True),
    "encode_dropout_0": count,
    "tokens_per_lang": count,
    "encode_dropout_1": lambda i, t: (len(t.encode()),),
}


@pytest.mark.parametrize("name", sorted(HAND))
def test_query_over_portions(spark, long_rows, tmp_path, name):
    texts, df = long_rows
    df.selectExpr("*", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in q.queries()[name](spark, str(tmp_path)).collect()}
    want = {i: HAND[name](i, t or "") for i, t in enumerate(texts)}
    if name == "tokens_per_lang":
        n = [x for (x,) in want.values() if x]
        want = {"en": (len(n), sum(n))}
    assert {i: x[-len(want[i]) :] for i, x in got.items()} == want


KINDS = ["a", "Z", "é", "中", "𝒜", "1", "٣", "𝟗", " ", " ", "\n", "\t", "\u00a0", "\u0085", "\u2028", "'", "'", "'s", "'re", "'ll", "'ve", "s", "r", "e", "l", "_", "!", "😀", "\u200d", "\u0301", "\0", "\x1c"]


def test_texts_are_cut_as_the_pattern_cuts_them(spark):
    """Pieces and offsets of the splitter in Python against the one of native expressions, with and without a space put in front."""
    rng = random.Random(7)
    texts = ["", " ", "'", "'s", "'re", "'r", " 's", "'s's", "'sabc", "''s", "\n's", "  a", "a  ", "a \n", "\n \nb", None]
    texts += ["".join(rng.choices(KINDS, k=rng.randint(1, 30))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3).cache()
    model = fixed_model()
    for step in (pt.ByteLevel(False), pt.ByteLevel(True)):
        for compat in (False, True):
            whole = F.coalesce("text", F.lit(""))
            native = encode_pieces(df, pt.unwritten(whole, step)[0], model, False, write=True, compat_offsets=compat)
            want = {r["i"]: r["encoding"] for r in native.select("i", "encoding").collect()}
            got = {r["i"]: r["encoding"] for r in encode(df, "text", model, step, compat_offsets=compat).select("i", "encoding").collect()}
            assert got == want and len(got) == len(texts)


def test_every_character_is_of_the_kind_that_the_pattern_takes_it_for(spark):
    kind = byte_level.kinds(spark)
    every = spark.range(0x110000).filter("id < 55296 OR id >= 57344").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    one = lambda pattern: F.col("c").rlike("(?U)^" + pattern + "$")
    told = F.when(one(r"\p{L}"), byte_level.LETTER).when(one(r"\p{N}"), byte_level.NUMBER).when(one(r"\s"), byte_level.WHITE).otherwise(byte_level.OTHER)
    rows = every.select("id", told.alias("k")).filter("k > 0").collect()
    want = np.zeros(0x110000, np.uint8)
    want[[r["id"] for r in rows]] = [r["k"] for r in rows]
    assert np.array_equal(kind, want) and (want == byte_level.LETTER).sum() > 100_000


@pytest.mark.parametrize("name", [*sorted(HAND), "encode_ids"])
def test_only_the_text_goes_to_python(spark, sf_dir, name):
    """Arrays of pieces made by the JVM took an executor most of its memory."""
    plan = q.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_extract_all" not in plan


@pytest.mark.parametrize("name", ["encode_decode_roundtrip", "encode_offsets_prefix", "encode_offsets_compat"])
def test_texts_are_read_and_sent_in_parts(spark, sf_dir, name):
    """Scans of 4,096 rows and Arrow batches of 10,000 held a whole task's text in the JVM, some times over."""
    before = {k: spark.conf.get(k, None) for k in IN_PARTS}
    own = q.queries()[name](spark, sf_dir).sparkSession
    assert {k: int(own.conf.get(k)) for k in IN_PARTS} == IN_PARTS
    assert {k: spark.conf.get(k, None) for k in IN_PARTS} == before and spark.conf.get("parquet.read.allocation.size", None) is None
    assert (own.conf.get("parquet.read.allocation.size", None) == str(SMALL_READ)) == name.startswith("encode_offsets")


def test_parts_hold_all_rows(spark, tmp_path):
    """Parts are bounded in rows and bytes, and smaller settings stay."""
    texts = ["x" * 50] * 3000 + ["y" * 300_000] * 100
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    @F.arrow_udf("struct<n:int,bytes:long>")
    def seen(t: pa.Array) -> pa.Array:
        n = len(t)
        return pa.StructArray.from_arrays([pa.array([n] * n, pa.int32()), pa.array([pc.sum(pc.binary_length(t)).as_py()] * n)], ["n", "bytes"])

    got = in_parts(spark).read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", seen("text").alias("s")).select("doc_id", "s.*").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    assert max(r["n"] for r in got) <= 512 and max(r["bytes"] for r in got) <= (4 << 20) + 300_000
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for told, want in (("7", 7), ("0", 512), ("9999", 512)):
        session = spark.newSession()
        session.conf.set(key, told)
        assert int(in_parts(session).conf.get(key)) == want and session.conf.get(key) == told


@pytest.mark.parametrize("name", ["decode_ids", "encode_decode_roundtrip"])
def test_ids_are_decoded_without_a_search(spark, sf_dir, name):
    """Neither a map is searched for each token nor a table for each character of the text."""
    plan = q.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" in plan and "translate" not in plan and "element_at" not in plan


@pytest.mark.parametrize("name", ["encode_offsets", "encode_offsets_prefix", "encode_offsets_compat"])
def test_offsets_are_shown_in_the_pass(spark, sf_dir, name):
    """As texts made by the JVM, they took it more time and objects than the encoding."""
    plan = q.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(cast(" in plan and "zip_with" not in plan and "array_join" not in plan


def test_spans_are_the_starts_and_ends(spark):
    """Of each row: none, one and many tokens, rows without text, a space put in front, pieces made by the JVM."""
    texts = ["", None, "a", " the then", "é the\n\n12", "x" * 3000, written(2000)] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(2).cache()
    for step in (pt.ByteLevel(False), pt.ByteLevel(True), pt.whitespace()):
        every = encode(df, "text", fixed_model(), step, fields=("starts", "ends", SHOWN)).select("i", "encoding.*").collect()
        alone = {r["i"]: r["spans"] for r in encode(df, "text", fixed_model(), step, fields=(SHOWN,)).select("i", "encoding.spans").collect()}
        assert all(r["spans"] == alone[r["i"]] == " ".join(f"{a}-{b}" for a, b in zip(r["starts"], r["ends"])) for r in every) and len(every) == len(texts)
    assert encode(df, "text", fixed_model()).select("encoding.*").columns == ["ids", "tokens", "starts", "ends"]


@pytest.mark.parametrize("far", [0, 1_000_000, -5])
@pytest.mark.parametrize("skip", [True, False])
def test_decoding_against_each_token_by_itself(spark, far, skip):
    """Ids that are places in a table or not; unknown and null ids, tokens of other characters, bytes that are no text."""
    texts = [*bc.TABLE.values(), "<s>", "<", "<a", "中", "Ġ中", "é", "<é>", "ab", ""]
    model = Bpe({t: i + far for i, t in enumerate(dict.fromkeys(texts))})
    rng = random.Random(3)
    rows = [[rng.choice([*model.tokens, -1, 7_999, 2**31 - 1, None]) for _ in range(n)] for n in [0, 1, 2, 3, 500] * 4] + [[i + far for i in "aé中 \0".encode()], None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, ids array<int>")
    got = {r["i"]: r["decoded"] for r in dc.decode(df, "ids", model, skip).select("i", "decoded").collect()}
    for i, r in enumerate(rows):
        kept = [model.tokens[x] for x in r or [] if x in model.tokens]
        raw = b"".join(bc.unmap_chars(t) for t in kept if not (skip and t.startswith("<") and t.endswith(">")))
        assert got[i] == (None if r is None else raw.decode("utf-8", "replace"))


def test_numbers_of_many_random_sources():
    seeds = ["1:0", "12:345", "-7:1", "0.1234:99", "123456789012:7", "None:3"]
    got = first_draws([x.encode() for x in seeds], 20)
    for k, x in enumerate(seeds):
        rng = random.Random(x)
        assert got[:, k].tolist() == [rng.random() for _ in range(20)]


@pytest.mark.parametrize("draws", [1, 10])
def test_dropout_of_many_pieces_at_once(monkeypatch, draws):
    """As one by one, pieces that run out of numbers and long ones included; Python's random sources are set for those alone."""
    from tokenloom.operators import encode as en

    texts, m = [written(3000, i) for i in range(4)] + ["", "the", "x"], fixed_model(dropout=0.5)
    monkeypatch.setattr(en, "DRAWS", draws)
    monkeypatch.setattr(en, "AT_ONCE", 100)
    made = []
    monkeypatch.setattr(en.random, "Random", lambda s, real=random.Random: made.append(s) or real(s))
    got = Words(m, True, 10, True).one_by_one(given_rows(texts), list(range(len(texts)))).to_pylist()
    monkeypatch.undo()
    pieces = [SPLIT.findall(t) for t in texts]
    for i, row in enumerate(pieces):
        want = [x for k, p in enumerate(row) for x in merge_with_dropout(m.symbols(bc.map_bytes(p.encode())), m.table, 0.5, random.Random(f"{i}:{k}"))]
        assert got[i]["ids"] == [x for x, _ in want] and got[i]["ends"] == np.cumsum([len(m.tokens[x]) for x, _ in want]).astype(int).tolist()
    assert draws == 1 or len(made) < sum(map(len, pieces)) / 2

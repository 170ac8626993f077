import json

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import bytechars as bc
from tokenloom.functions import normalize as nz
from tokenloom.operators import decode as dc
from tokenloom.operators import postprocess as pp
from tokenloom.operators import pretokenize as pt
from tokenloom.operators.encode import encode, encode_pieces, native_tokens
from tokenloom.operators.model import Bpe, Options
from tokenloom.plans.tokenizer import Tokenizer
from tokenloom.sources import files
from tokenloom.streaming.counts import stream_encode, stream_word_counts

BYTES = {bc.TABLE[b]: b for b in range(256)}
E4B8, E59B = bc.map_bytes(b"\xe4\xb8"), bc.map_bytes(b"\xe5\x9b")
ZH = BYTES | {bc.map_bytes("中".encode()): 256, bc.map_bytes("国".encode()): 257, E4B8: 258, E59B: 259}
ZH_MERGES = ((bc.TABLE[0xE4], bc.TABLE[0xB8]), (E4B8, bc.TABLE[0xAD]), (bc.TABLE[0xE5], bc.TABLE[0x9B]), (E59B, bc.TABLE[0xBD]))
LARK = {"L": 0, "a": 1, "r": 2, "k": 3, "ar": 4, "Lark": 5, "Ġsang": 6, "s": 7, "n": 8, "g": 9, "Lar": 10, "Ġ": 11, "ĠLark": 12}
LARK_MERGES = (("a", "r"), ("L", "ar"), ("Lar", "k"))


def encodings(spark, tok, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return [r["encoding"].asDict() for r in tok.encode(df).orderBy("id").collect()]


def spans(e):
    return list(zip(e["starts"], e["ends"]))


def test_offsets_and_round_trip(spark):
    tok = Tokenizer(Bpe(ZH, ZH_MERGES), None, pt.ByteLevel(False))
    a, b, c, d = encodings(spark, tok, "中国", "a中b", None, "")
    assert spans(a) == [(0, 3), (3, 6)] and spans(b) == [(0, 1), (1, 4), (4, 5)] and c["ids"] == d["ids"] == []
    df = spark.createDataFrame([(a["ids"],), (b["ids"],), ([],), ([999],)], "ids array<int>")
    assert [r[0] for r in tok.decode(df, "ids").select("decoded").collect()] == ["中国", "a中b", "", ""]


def test_late_writing_is_the_same(spark):
    m = Bpe(ZH, ZH_MERGES)
    df = spark.createDataFrame([(t,) for t in ("中国 a1", " 中", "", "é x")], "text string")
    for pre in (pt.ByteLevel(), pt.ByteLevel(False, True, False), pt.Sequence((pt.Split(r"\d"), None, pt.ByteLevel()))):
        late = encode(df, "text", m, pre).select("encoding").collect()
        early = encode_pieces(df, pt.pieces_of(F.col("text"), pre), m, True).select("encoding").collect()
        assert late == early


def test_prefix_space(spark):
    tok = Tokenizer(Bpe(LARK, LARK_MERGES, Options(ignore_merges=True)), None, pt.ByteLevel())
    (e,) = encodings(spark, tok, "Lark sang")
    assert e["tokens"] == ["ĠLark", "Ġsang"] and spans(e) == [(0, 4), (4, 9)]
    assert spans(encodings(spark, tok.with_(compat_offsets=True), "Lark sang")[0]) == [(0, 5), (4, 9)]
    df = spark.createDataFrame([(e["ids"],)], "ids array<int>")
    assert tok.decode(df, "ids").first()["decoded"] == " Lark sang"
    assert tok.with_(decoder=None).decode(df, "ids").first()["decoded"] == ""


def test_normalized_offsets(spark):
    v = {"x": 0, "y": 1, "xy": 2}
    tok = Tokenizer(Bpe(v, (("x", "y"),)), nz.sequence(nz.strip(), nz.lowercase()))
    (e,) = encodings(spark, tok, "  XY ")
    assert e["ids"] == [2] and spans(e) == [(2, 4)]
    assert encodings(spark, Tokenizer(), "abc")[0]["ids"] == []


def test_trim(spark):
    def trimmed(token, start, end, prefix, first=True):
        tokens, starts, ends = ([token], [start], [end]) if first else (["a", token], [0, start], [1, end])
        df = spark.createDataFrame([(tokens, starts, ends, [0] * len(tokens))], "tokens array<string>, starts array<int>, ends array<int>, ids array<int>")
        r = pp.trim_offsets(df.select(F.struct("ids", "tokens", "starts", "ends").alias("e")), "e", prefix).first()["e"]
        return r["starts"][-1], r["ends"][-1]

    assert trimmed("ĠseaĠ", 20, 27, False, False) == (21, 26)
    assert trimmed("ĠLark", 0, 4, True)[0] == 0 and trimmed("ĠĠLark", 0, 5, True)[0] == 2
    assert trimmed("ĠĠ", 0, 2, False, False) == (2, 2)


def test_truncation_and_padding(spark):
    tok = Tokenizer(Bpe({c: i for i, c in enumerate("abcdef")}, ()))
    assert encodings(spark, tok.with_(truncation=pp.Truncation(2)), "abcdef")[0]["ids"] == [0, 1]
    tail = encodings(spark, tok.with_(truncation=pp.Truncation(2, 1, True)), "abcdef", "a")
    assert [e["ids"] for e in tail] == [[4, 5], [0]] and tail[0]["attention_mask"] == [1, 1]
    got = encodings(spark, tok.with_(padding=pp.Padding(pad_id=12, pad_type_id=3)), "abc", "a", "")
    assert [e["ids"] for e in got] == [[0, 1, 2], [0, 12, 12], [12] * 3]
    assert got[1]["attention_mask"] == [1, 0, 0] and got[1]["type_ids"] == [0, 3, 3] and got[1]["tokens"][1:] == ["<pad>"] * 2
    assert encodings(spark, tok.with_(padding=pp.Padding(2)), "abc")[0]["ids"] == [0, 1, 2]
    df = spark.createDataFrame([("x", "abc"), ("x", "a"), ("y", "a"), (None, "ab")], "b string, text string")
    rows = tok.with_(padding=pp.Padding(pad_id=9)).encode(df, batch="b").collect()
    assert sorted((r["b"] or "", len(r["encoding"]["ids"])) for r in rows) == [("", 2), ("x", 3), ("x", 3), ("y", 1)]


def test_dropout_is_a_function_of_the_seed(spark):
    v = {c: i for i, c in enumerate("abcd")} | {"ab": 4, "cd": 5, "abcd": 6}
    tok = Tokenizer(Bpe(v, (("a", "b"), ("c", "d"), ("ab", "cd")), Options(dropout=0.5)))
    df = spark.range(200).select("id", F.lit("abcd").alias("text"))
    one, two = ([r["encoding"]["ids"] for r in tok.encode(df, seed=F.col("id")).orderBy("id").collect()] for _ in range(2))
    assert one == two and len({tuple(x) for x in one}) > 2


def test_dropout_half_by_hand(spark, sf_dir):
    """The query, against a sweep over all candidates for each merge."""
    import random

    import regex

    from tokenloom import queries as q
    from tokenloom.functions.regex_compat import GPT2

    from .test_model import dropped_by_hand

    m, split = q.fixed_model(dropout=0.5), regex.compile(GPT2)
    docs = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r["text"]) < 3000]
    want = {}
    for r in docs:
        pieces = [bc.map_bytes(p.encode()) for p in split.findall(r["text"])]
        rngs = (random.Random(f"{r['doc_id']}:{i}") for i in range(len(pieces)))
        want[r["doc_id"]] = sum(len(dropped_by_hand(m.symbols(p), m.table, 0.5, rng)) for p, rng in zip(pieces, rngs))
    got = {r["doc_id"]: r["n_tokens"] for r in q.queries()["encode_dropout_half"](spark, sf_dir).collect()}
    assert want and {i: got[i] for i in want} == want


def test_training_demo(spark, tmp_path):
    from tokenloom.plans import demo

    tokenizer, shown = demo.train_demo(spark, f"{tmp_path}/demo.json")
    rows = shown.collect()
    assert [r["decoded"] for r in rows] == list(demo.LINES) and tokenizer.model.vocab["<unk>"] == 0 and tokenizer.model.vocab["<pad>"] == 1
    assert tokenizer.model.vocab_size == 80 and any(len(r["tokens"]) < len(r["text"]) / 2 for r in rows)


def test_native_equals_udf(spark):
    m = Bpe(ZH, ZH_MERGES)
    df = spark.createDataFrame([(bc.map_bytes(t.encode()),) for t in ("中国", "a中", "xyz", "")], "w string")
    for r in df.select("w", native_tokens(F.col("w"), m).alias("t")).collect():
        assert r["t"] == [m.tokens[i] for i, _ in m.encode(r["w"])]
    with pytest.raises(ValueError):
        native_tokens(F.lit("a"), Bpe(ZH, ZH_MERGES, Options(byte_fallback=True)))


def test_files(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"a":0,"b":1,"ab":2,"a":7}')
    for text in ("a b\n", "#version: 0.1\n\na b\r\nnospace\n"):
        (tmp_path / "m.txt").write_text(text)
        m = files.from_files(spark, f"{tmp_path}/v.json", f"{tmp_path}/m.txt")
        assert [i for i, _ in m.encode("ab")] == [2] and m.vocab["a"] == 0
    for bad in ("{not json", "[1]", '{"a":"x"}', '{"a":1.5}'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(files.FileProblem):
            files.read_vocab(spark, f"{tmp_path}/bad.json")
    with pytest.raises(files.FileProblem):
        files.read_vocab(spark, f"{tmp_path}/none.json")


def test_tokenizer_json(spark, tmp_path):
    d = {"version": "1.0", "normalizer": None, "truncation": None, "post_processor": None, "decoder": None, "added_tokens": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"\p{L}+"}}, {"type": "Other"}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]}, "model": {"type": "BPE", "unk_token": None, "vocab": {"a": 0, "b": 1, "ab": 2, "Ġ": 3}, "merges": [["a", "b"], "  a  b  ", "x y", "onlyone"]}}
    path = f"{tmp_path}/t.json"
    (tmp_path / "t.json").write_text(json.dumps(d))
    tok = Tokenizer.from_file(spark, path)
    assert encodings(spark, tok, "ab ab")[0]["ids"] == [2, 3, 2]
    tok.with_(normalizer=nz.strip(), post_processor=pt.ByteLevel()).to_file(spark, f"{tmp_path}/again.json")
    again = Tokenizer.from_file(spark, f"{tmp_path}/again.json")
    assert again.model.merges_list() == tok.model.merges_list() and again.normalizer.kind == "Strip" and again.pre_tokenizer == tok.pre_tokenizer and again.post_processor == pt.ByteLevel()
    tok.to_vocab_merges(spark, str(tmp_path))
    assert files.read_merges(spark, f"{tmp_path}/merges.txt") == [("a", "b")]
    (tmp_path / "w.json").write_text(json.dumps({"model": {"type": "WordPiece"}}))
    with pytest.raises(files.FileProblem):
        Tokenizer.from_file(spark, f"{tmp_path}/w.json")
    with pytest.raises(ValueError):
        Tokenizer().to_vocab_merges(spark, str(tmp_path))
    assert files.parse_pre_tokenizer({"type": "Sequence", "pretokenizers": [{"type": "X"}]}) == pt.ByteLevel() and files.parse_pre_tokenizer({"type": "X"}) is None


def test_big_vocabulary_decodes_like_a_small_one(spark, monkeypatch):
    m = Bpe(ZH, ZH_MERGES)
    df = spark.createDataFrame([([256, 97, 999, 257],), ([],), (None,)], "ids array<int>")
    small = dc.decode(df, "ids", m).collect()
    monkeypatch.setattr(dc, "MAP_LIMIT", 0)
    assert dc.decode(df, "ids", m).collect() == small and small[0]["decoded"] == "中a国"


def test_streams(spark, tmp_path):
    spark.createDataFrame([("ab ab",), ("ab c",), (None,)], "text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("text string").parquet(f"{tmp_path}/in")
    stream_word_counts(stream, "text", pt.whitespace()).writeStream.outputMode("complete").format("memory").queryName("wc").trigger(availableNow=True).start().awaitTermination()
    assert {r["word"]: r["n"] for r in spark.table("wc").collect()} == {"ab": 3, "c": 1}
    tok = Tokenizer(Bpe({"a": 0, "b": 1, " ": 2, "ab": 3}, (("a", "b"),)))
    stream_encode(stream.filter("text IS NOT NULL"), tok).writeStream.format("memory").queryName("enc").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["encoding"]["ids"] for r in spark.table("enc").collect()) == [[], [3, 2, 3]]
    with pytest.raises(ValueError):
        stream_encode(stream, tok.with_(padding=pp.Padding()))
    timed = spark.readStream.format("rate").load().select("timestamp", F.lit("a b").alias("text"))
    assert "watermark" in stream_word_counts(timed, "text", pt.whitespace(), "timestamp", "1 minute", "2 minutes")._jdf.queryExecution().logical().toString().lower()


def test_own_parts(spark):
    v = {"a": 0, "b": 1, "<s>": 2}
    first = lambda e: F.struct(*(F.slice(e[k], 1, 1).alias(k) for k in ("ids", "tokens", "starts", "ends")))
    tok = Tokenizer(Bpe(v), None, pt.whitespace(), first, lambda tokens: F.array_join(tokens, "-"))
    assert encodings(spark, tok, "b a")[0]["ids"] == [1]
    df = spark.createDataFrame([([0, 2, 1],)], "ids array<int>")
    assert tok.decode(df, "ids").first()["decoded"] == "a-b" and tok.decode(df, "ids", skip_special_tokens=False).first()["decoded"] == "a-<s>-b"

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import bytechars as bc
from tokenloom.functions import normalize as nz
from tokenloom.functions import regex_compat as rx
from tokenloom.operators import pretokenize as pt

HOW = "Some larks sing, do you hear them now?"


def run(spark, text, pre):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    rows = pt.with_offsets(df, "id", pt.pieces_of(F.col("t"), pre), bool(pre and pre.mapped)).orderBy("pos").collect()
    return [(r["text"], (r["start"], r["end"])) for r in rows]


def texts(spark, text, pre):
    return [t for t, _ in run(spark, text, pre)]


def test_byte_level(spark):
    got = run(spark, HOW, pt.ByteLevel(False))
    assert [t for t, _ in got] == "Some Ġlarks Ġsing , Ġdo Ġyou Ġhear Ġthem Ġnow ?".split()
    assert [s for _, s in got] == [(0, 4), (4, 10), (10, 15), (15, 16), (16, 19), (19, 23), (23, 28), (28, 33), (33, 37), (37, 38)]
    assert run(spark, HOW, pt.ByteLevel(True))[:2] == [("ĠSome", (0, 4)), ("Ġlarks", (4, 10))]
    assert run(spark, " Some", pt.ByteLevel(True)) == [("ĠSome", (0, 5))]
    (one,) = run(spark, HOW, pt.ByteLevel(True, True, False))
    assert one[0][0] == "Ġ" and one[1] == (0, 38)


@pytest.mark.parametrize(
    "behavior, want",
    [
        ("Removed", ["one", "two", "three"]),
        ("Isolated", ["one", "/", "two", "/", "/", "three"]),
        ("MergedWithPrevious", ["one/", "two/", "/", "three"]),
        ("MergedWithNext", ["one", "/two", "/", "/three"]),
        ("Contiguous", ["one", "/", "two", "//", "three"]),
    ],
)
def test_split_behaviors(spark, behavior, want):
    assert texts(spark, "one/two//three", pt.Split("/", False, behavior)) == want
    assert [t for t, k in pt.Split("/", False, behavior).runs_of("one/two//three") if k] == want


@pytest.mark.parametrize(
    "behavior, want",
    [
        ("Removed", ["Who", "sings", "here", "!"]),
        ("Isolated", ["Who", " ", "sings", " ", "here", "!"]),
        ("MergedWithPrevious", ["Who ", "sings ", "here", "!"]),
        ("MergedWithNext", ["Who", " sings", " here", "!"]),
        ("Contiguous", ["Who", " ", "sings", " ", "here!"]),
    ],
)
def test_split_inverted(spark, behavior, want):
    got = texts(spark, "Who sings here!", pt.Split(r"\w+|[^\w\s]+", True, behavior, True))
    assert got == want


def test_split_edges(spark):
    same = pt.Split(" ", False, "Removed"), pt.Split("la", False, "Removed", True)
    assert texts(spark, "la la la", same[0]) == texts(spark, "la la la", same[1]) == ["la"] * 3
    assert texts(spark, "a b", pt.Split("(", True, "Removed")) == ["a b"]
    assert texts(spark, "axbxc", pt.Split("x*", True, "Removed")) == ["a", "b", "c"]
    assert texts(spark, "a\x01=b,c\x01", pt.Split(",", False, "MergedWithPrevious")) == ["a\x01=b,", "c\x01"]
    assert texts(spark, "abc", None) == ["abc"]


def test_sequence(spark):
    pre = pt.Sequence((pt.Split(r"\d{1,3}"), None, pt.Split(r"\s+", True, "Removed")))
    assert run(spark, "no77 way8042", pre) == [("no", (0, 2)), ("77", (2, 4)), ("way", (5, 8)), ("804", (8, 11)), ("2", (11, 12))]
    many = pt.Sequence((pt.Split(r"\p{N}{1,3}"), pt.Split(r"[一-龥]+"), pt.Split(r"[!?]"), pt.ByteLevel(False)))
    got = run(spark, "about 24680 山川? yes", many)
    words = [t for t, _ in got]
    assert {"246", "80", bc.map_bytes("山川".encode()), "?", "Ġyes"} <= set(words)
    assert got[0][1][0] == 0 and got[-1][1][1] == 23 and all(a[1][1] == b[1][0] for a, b in zip(got, got[1:]))


def test_bytes_round_trip(spark):
    raw = [chr(i) for i in range(0, 0x800)] + ["中国", "\U0001f600", ""]
    df = spark.createDataFrame([(t,) for t in raw], "t string")
    for r in df.select("t", bc.byte_chars(F.col("t")).alias("m"), bc.chars_to_text(bc.byte_chars(F.col("t"))).alias("b")).collect():
        assert r["m"] == bc.map_bytes(r["t"].encode()) and r["b"] == r["t"] and bc.unmap_chars(r["m"]) == r["t"].encode()
    mixed = spark.createDataFrame([("Ġa中b",), ("é",), ("ä¸",)], "t string").select("t", bc.chars_to_bytes(F.col("t")).alias("b")).collect()
    assert all(bytes(r["b"]) == bc.unmap_chars(r["t"]) for r in mixed)


def test_normalizers(spark):
    df = spark.createDataFrame([("  Larks \x0b",)], "t string")
    n = nz.sequence(nz.strip(), None, nz.lowercase())
    s, e = n.original(F.col("t"), F.lit(0), F.lit(1))
    assert tuple(df.select(n(F.col("t")), s, e).first()) == ("larks", 2, 3)
    one = spark.createDataFrame([("Blue Sky É",)], "t string")
    assert one.select(nz.uppercase()(F.col("t"))).first()[0] == "BLUE SKY É"
    assert one.select(nz.make("nothing")(F.col("t"))).first()[0] == "Blue Sky É"
    got = spark.createDataFrame([("Éa中",)], "t string").select(nz.byte_case(F.col("t"), False)).first()[0]
    assert bytes(got).hex().upper() == "E38961E4B8AD"


def test_splicing(spark):
    df = spark.createDataFrame([("abé",), ("",), ("x",)], "t string")
    show = lambda *c: [tuple(r) for r in df.select(*c).collect()]
    cut = lambda a, b, by: show(nz.replace_range(F.col("t"), a, b, by), nz.replace_alignment(F.col("t"), a, b, by))
    assert cut(1, 2, "--") == [("a--é", [0, 1, 1, 2, 3]), ("", []), ("x", [0])]
    assert cut(0, 0, "z") == [("zabé", [0, 0, 1, 2, 3]), ("z", [0]), ("zx", [0, 0])]
    assert cut(1, 1, "") == [("abé", [0, 1, 2, 3]), ("", []), ("x", [0])] and cut(2, 1, "q")[0] == ("abé", [0, 1, 2, 3])
    assert cut(4, 4, "!") == [("abé!", [0, 1, 2, 3, 3]), ("", []), ("x", [0])]
    assert show(*nz.append(F.col("t"), "é")) == [("abéé", [0, 1, 2, 3, 4, 4]), ("é", [0, 0]), ("xé", [0, 1, 1])]


def test_translate(spark):
    assert rx.translate("a{") == "(?U)a\\{" and rx.translate("a{2,3}") == "(?U)a{2,3}"
    assert rx.translate("[[a&&b]") == "(?U)[\\[a&\\&b]" and rx.usable(rx.translate("[]a]{"))
    assert not rx.usable("(") and rx.escape("a.b*") == "a\\.b\\*"


@pytest.mark.parametrize("behavior", pt.BEHAVIORS)
def test_native_split_equals_python(spark, behavior):
    import random

    rng = random.Random(3)
    raw = ["".join(rng.choice("ab-\x01é=+ ") for _ in range(rng.randint(0, 14))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in raw], "t string")
    for invert in (False, True):
        for pre in (pt.Split("-+", True, behavior, invert), pt.Split("=", False, behavior, invert)):
            for r in df.select("t", pt.pieces_of(F.col("t"), pre).alias("p")).collect():
                assert [(x["t"], x["k"]) for x in r["p"]] == pre.runs_of(r["t"]), (r["t"], pre)


def test_pieces_tile_the_text(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", pt.pieces_of(F.col("text"), pt.ByteLevel(False)).alias("p")).collect()
    assert all(bc.unmap_chars("".join(x["t"] for x in r["p"])).decode() == r["text"] for r in rows)

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import decontaminate as dc
from tokenloom.llm import urls

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def distance(a, b):
    """Least edit distance of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edits_are_exact():
    rng = random.Random(4)
    block = dc.ItemBlock([(0, "a b c a b d"), (1, " ".join(rng.choice("abcde") for _ in range(70)))], dc.Cgk())
    for item, x in enumerate(block.items):
        for _ in range(200):
            passage = np.array([rng.randrange(0, 6) for _ in range(rng.randint(0, 90))], np.int64)
            assert block.edits(item, passage) == distance(x.tolist(), passage.tolist())


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))) for i in range(30)]
    docs = []
    for d in range(n):
        host = [rng.choice(words) for _ in range(rng.randint(0, 300))]
        if d % 2:
            i, text = rng.choice(items)
            w = text.split()
            for _ in range(rng.randint(0, dc.Cgk().allowed(len(w)))):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([["zz"], [], [w[k], "yy"]])
            at = rng.randint(0, len(host))
            host[at:at] = w
        docs.append((d, " ".join(host)))
    return items, docs


def test_matches_by_hand(spark):
    items, docs = corpus()
    want = {(d, i) for d, t in docs for i, x in items if distance(x.split(), t.split()) <= dc.Cgk().allowed(len(x.split()))}
    df = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("clash"))
    got = dc.contaminated(df, spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(3)))
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert found <= want and len(found) >= 0.95 * len(want)
    kept = dc.drop_contaminated(df, spark.createDataFrame(items, ITEMS))
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in found}


def test_edges_of_input(spark, monkeypatch):
    items = [(1, "one two three four five six"), (2, None), (None, "x y"), (3, ""), (4, "Solo"), (1, "one two three four five six"), (5, "pair here")]
    docs = [(1, "say ONE two three FOUR five six now"), (2, None), (3, ""), (None, "solo"), (4, "one two three six"), (5, "x " * 30_000 + "one two three four zzz six"), (1, "solo"), (6, "pair  here")]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    docs.append((7, "my x y z"))
    df = spark.createDataFrame(docs, DOCS)
    want = [(-1, 4, 0), (1, 1, 0), (1, 4, 0), (5, 1, 1), (6, 5, 0), (7, -1, 0)]
    got = lambda: sorted((r["doc_id"] or -1, r["item_id"] or -1, r["edits"]) for r in dc.contaminated(df, bench).collect())
    assert got() == want
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 1)
    assert got() == want
    assert sorted(r["doc_id"] for r in dc.drop_contaminated(df, bench).collect()) == [2, 3, 4]
    assert dc.contaminated(df, bench.limit(0)).count() == 0 and dc.contaminated(df.limit(0), bench).count() == 0
    assert dc.drop_contaminated(df, bench.limit(0)).count() == len(docs)


def test_beyond_the_most_tables_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(dc, "MOST_TABLES", 3)
    items, docs = corpus(5)
    assert dc.ItemBlock(items, dc.Cgk()).walks == 0
    want = {(d, i) for d, t in docs for i, x in items if distance(x.split(), t.split()) <= dc.Cgk().allowed(len(x.split()))}
    block = dc.ItemBlock(items, dc.Cgk())
    assert want and {(d, m[0]) for d, t in docs for m in block.matches(t)} == want


def test_op4_finds_every_verbatim_passage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    want = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in dc.op4_benchmark_decontamination(spark, sf_dir).collect()}
    assert want and want <= set(got) and all(got[x] == 0 for x in want)


URLS = [
    ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("https://example.net/de/", "example.net", "/de/", "net/", "block"),
    ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
    ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
    ("http://x.org/fr/?a", "x.org", "/fr/", "org/fr/", "allow"),
    ("http://example.net", "example.net", "", None, "block"),
    ("http://example.net?x/y", "example.net", "", None, "block"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("http:///net/x", "", "/net/x", None, "allow"),
    ("a://b.net/c://d.com/", "b.net", "/c://d.com/", "net/", "block"),
]


def test_rules(spark):
    rows = [(i, u, None) for i, (u, *_) in enumerate(URLS)] + [(0, URLS[0][0], "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(1)).withColumn("host", F.lit(2))
    got = urls.judge_urls(df, urls.rules_frame(spark, urls.RULES))
    by_id = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
    assert by_id == {i: tuple(x[1:]) for i, x in enumerate(URLS)} and got.count() == len(rows)
    assert urls.judge_urls(df.limit(0), urls.rules_frame(spark, urls.RULES)).count() == 0


def rank_by_hand(links, seeds, forward, damping=0.85, rounds=300):
    total = sum(seeds.values()) or 1
    start = {h: s / total for h, s in seeds.items()}
    edges = links if forward else {(b, a): n for (a, b), n in links.items()}
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    now = dict(start)
    for _ in range(rounds):
        new = {h: (1 - damping) * s for h, s in start.items()}
        for (a, b), n in edges.items():
            new[b] = new.get(b, 0) + damping * now.get(a, 0) * n / out[a]
        now = new
    return now


def test_propagation_by_hand(spark):
    links = {("good", "fine"): 3, ("fine", "good"): 1, ("spam", "bad"): 2, ("fine", "mixed"): 1, ("mixed", "bad"): 5, ("bad", "bad"): 1, ("lone", "lone"): 1, ("farm", "spam"): 1}
    trust, distrust = {"good": 2}, {"bad": 4}
    seeds = spark.createDataFrame([("good", 2, 0), ("bad", 0, 4)], "host string, trust long, distrust long")
    got = {r["host"]: r for r in urls.propagate(spark.createDataFrame([(*k, n) for k, n in links.items()], "src string, dst string, n long"), seeds).collect()}
    t, d = rank_by_hand(links, trust, True), rank_by_hand(links, distrust, False)
    assert "lone" not in got
    for h, r in got.items():
        assert r["trust"] == pytest.approx(t.get(h, 0)) and r["distrust"] == pytest.approx(d.get(h, 0))
    assert got["farm"]["distrust"] > 0 == got["farm"]["trust"]


def test_distrust_reaches_far(spark):
    """A chain of 30 hosts to a blocked one: all are blocked, whatever the number of rounds that takes."""
    rows = [(i, f"http://h{i}.com/x", f"<a href='http://h{i + 1}.com/x'>") for i in range(30)] + [(30, "http://h30.com/x", "<a href='http://bad.net/x'>"), (31, "http://lone.com/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    # a rule makes a seed of a host with pages of its own
    got = urls.judge_urls(df.unionByName(spark.createDataFrame([(32, "http://bad.net/x", "")], df.schema)), urls.rules_frame(spark, urls.RULES)).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "allow"} == {31} and len(got) == 33
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [*map(list, rows), [32, "http://bad.net/x", ""]])
    assert {r[0]: r[4] for r in con.sql(urls.OP6_SQL).fetchall()} == {r["page_id"]: r["verdict"] for r in got}


def test_links(spark):
    html = """<a href="/x">a</a><A HREF='http://Other.org/p'>b</A><a href=//third.net/q>c</a><a href="mailto:x@y">d</a> <a href="#top">e</a>"""
    df = spark.createDataFrame([("http://own.com/1", html), ("http://own.com/2", html), ("bad", html), (None, None)], "url string, html string")
    got = {(r["src"], r["dst"]): r["n"] for r in urls.host_links(df).collect()}
    assert got == {("own.com", "own.com"): 4, ("own.com", "other.org"): 2, ("own.com", "third.net"): 2}


def test_op6(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    got = urls.op6_url_filters(spark, sf_dir).toPandas()
    want = con.sql(urls.OP6_SQL).df()
    cols = sorted(got.columns)
    tidy = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True).replace({"None": "nan"})
    assert tidy(got).equals(tidy(want)) and set(got["verdict"]) == {"allow", "block"}

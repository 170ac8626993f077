import random

import numpy as np
import pytest

from tokenloom.llm import simhash as sh

DOCS = "doc_id long, text string"


def sets_of(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard(a, b):
    a, b = sets_of(a), sets_of(b)
    return len(a & b) / len(a | b)


def components_by_hand(rows, similarity):
    comp = {i: i for i, _ in rows}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    sets = {i: sets_of(t) for i, t in rows}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and len(a & b) >= similarity * len(a | b):
                x, y = sorted((find(i), find(j)))
                comp[y] = x
    return {i: find(i) for i, _ in rows}


def prose(rng, n):
    return [str(rng.randrange(10**7)) for _ in range(n)]


def test_links_are_those_of_the_similarity(spark):
    """Pairs above 0.8 link, pairs at 0.70 to 0.79 do not."""
    rng, rows = random.Random(4), []
    for i in range(400):
        n = 300
        w = prose(rng, n)
        kept = round((n - 4) * (1.62 / 1.81 if i % 2 else 1.5 / 1.75))  # shared shingles at 0.81 and 0.75
        v = w[: kept + 4] + prose(rng, n - kept - 4)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    got = {r["doc_id"]: r["component_id"] for r in sh.near_duplicates(spark.createDataFrame(rows, DOCS), sh.SimHash.for_similarity(0.8)).collect()}
    linked = [got[2 * i + 1] == 2 * i for i in range(400)]
    assert sum(linked[1::2]) >= 195 and not any(linked[::2])
    assert sh.SimHash.for_similarity(0.8).expected_recall(0.8) > 0.99


def test_recall_at_the_similarity(spark):
    """Of 1,500 pairs of a similarity of just over 0.8, nearly all link."""
    rng, rows = random.Random(14), []
    for i in range(1500):
        w = prose(rng, 204)
        v = w[:182] + prose(rng, 22)  # 178 of 222 shingles
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    assert 0.8 <= jaccard(rows[0][1], rows[1][1]) < 0.803
    got = {r["doc_id"]: r["component_id"] for r in sh.near_duplicates(spark.createDataFrame(rows, DOCS), sh.SimHash.for_similarity(0.8)).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(1500)) >= 0.97 * 1500


def test_pivots_discard_and_lose_nothing():
    """Most pairs of unlike fingerprints go by their pivot distances alone, and none within the radius."""
    p, rng = sh.SimHash.for_similarity(0.8), np.random.default_rng(5)
    words = rng.integers(0, 1 << 64, (2000, p.held), dtype=np.uint64)
    table = sh.pivot_table(words, p)
    bound = np.abs(table[:-1] - table[1:]).max(axis=1).sum(axis=1)
    assert (bound > p.radius).mean() > 0.99
    near = words.copy()
    for row in near:
        for b in rng.choice(64 * p.held, p.radius, replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    assert sh.near(words, near, table, sh.pivot_table(near, p), p.radius).all()
    one = sh.SimHash()
    table = sh.pivot_table(words[:, :1], one)
    assert (np.abs(table[:-1] - table[1:]).max(axis=1).sum(axis=1) > 3).mean() > 0.99


def test_repeats_do_not_vote(spark):
    """Documents that share one passage, repeated, and differ in the rest have different shingles."""
    rng = random.Random(6)
    passage = " ".join(prose(rng, 34))
    rows = [(i, " ".join([passage] * 40 + prose(rng, 100))) for i in range(6)]
    assert max(jaccard(rows[0][1], r[1]) for r in rows[1:]) < 0.5
    got = sh.drop_near_duplicates(spark.createDataFrame(rows, DOCS), sh.SimHash.for_similarity(0.8))
    assert got.count() == 6


@pytest.mark.parametrize("members", [128, 5])
def test_groups_by_hand(spark, monkeypatch, members):
    """Groups of copies of copies, whose links only partly hold, with repeated and empty rows."""
    monkeypatch.setattr(sh, "MEMBERS", members)
    rng, rows = random.Random(8), []
    for g in range(3):
        base = prose(rng, 120)
        texts = [base]
        for _ in range(25):
            w = list(rng.choice(texts))
            at = rng.randrange(110)
            w[at : at + rng.randint(1, 14)] = prose(rng, 9)
            texts.append(w)
        rows += [(100 * g + i, " ".join(w)) for i, w in enumerate(texts)]
    rows += [(900, rows[0][1]), (901, "one two"), (902, "One  two"), (903, "")]
    p = sh.SimHash.for_similarity(0.8, tables=400)
    want = components_by_hand(rows, 0.8)
    df = spark.createDataFrame([*rows, (904, None), (0, rows[0][1])], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in sh.near_duplicates(df, p).collect()}
    assert got.pop(904) == 903 and got == want and len(set(want.values())) > 5

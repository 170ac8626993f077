import random
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tokenloom.operators.model import Bpe, Options, merge, merge_with_dropout

NOTES = {"n": 0, "o": 1, "t": 2, "e": 3, "no": 4, "not": 5, "te": 6}
NOTES_MERGES = (("n", "o"), ("no", "t"), ("t", "e"))
UNK = {"a": 0, "b": 1, "c": 2, "<unk>": 3, "ab": 5}


def ids(x):
    return [i for i, _ in x]


def spans(x):
    out, at = [], 0
    for _, n in x:
        out.append((at, at + n))
        at += n
    return out


@pytest.mark.parametrize(
    "symbols, merges, want",
    [
        ([1, 2, 3], {(1, 2): (0, 12)}, [12, 3]),
        ([1, 2, 3], {(1, 2): (1, 12), (2, 3): (0, 23)}, [1, 23]),
        ([1, 2, 3, 4], {(1, 2): (0, 12), (12, 3): (1, 123), (123, 4): (2, 1234)}, [1234]),
        ([1, 2, 1, 2], {(1, 2): (0, 12)}, [12, 12]),
        ([1, 2, 2, 3], {(1, 2): (1, 12), (2, 2): (0, 22), (2, 3): (2, 23)}, [1, 22, 3]),
        ([1, 1, 1], {(1, 1): (0, 11)}, [11, 1]),
    ],
)
def test_merge(symbols, merges, want):
    assert ids(merge([(s, 1) for s in symbols], merges)) == want
    assert ids(merge_with_dropout([(s, 1) for s in symbols], merges, 0.0, random.Random(0))) == want


@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.dictionaries(st.tuples(st.integers(0, 6), st.integers(0, 6)), st.integers(4, 6), max_size=10))
def test_merge_is_least_rank_leftmost_first(symbols, table):
    ranked = {p: (r, new) for r, (p, new) in enumerate(table.items())}
    out = [(s, 1) for s in symbols]
    while found := [(*ranked[p], i) for i in range(len(out) - 1) if (p := (out[i][0], out[i + 1][0])) in ranked]:
        _, new, i = min(found, key=lambda x: (x[0], x[2]))
        out[i : i + 2] = [(new, out[i][1] + out[i + 1][1])]
    assert merge([(s, 1) for s in symbols], ranked) == out


def dropped_by_hand(symbols, table, rate, rng):
    """All candidates in order, one draw each, until one is taken; then from the start again."""
    out = list(symbols)
    while True:
        found = sorted((*table[p], i) for i in range(len(out) - 1) if (p := (out[i][0], out[i + 1][0])) in table)
        for _, new, i in found:
            if rng.random() >= rate:
                out[i : i + 2] = [(new, out[i][1] + out[i + 1][1])]
                break
        else:
            return out


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.dictionaries(st.tuples(st.integers(0, 6), st.integers(0, 6)), st.integers(2, 6), max_size=12), st.sampled_from([0.0, 0.1, 0.5, 0.9, 1.0]), st.integers(0, 99))
def test_dropout_by_hand(symbols, table, rate, seed):
    ranked = {p: (r, new) for r, (p, new) in enumerate(table.items())}
    pairs = [(s, 1) for s in symbols]
    assert merge_with_dropout(pairs, ranked, rate, random.Random(seed)) == dropped_by_hand(pairs, ranked, rate, random.Random(seed))


@pytest.mark.parametrize("rate", [0.0, 0.5, 1.0])
def test_dropout_of_long_words(rate):
    table = {(0, 1): (0, 2), (2, 2): (1, 3), (3, 2): (2, 4), (3, 3): (3, 5)}
    at = time.process_time()
    got = merge_with_dropout([(0, 1), (1, 1)] * 20_000, table, rate, random.Random(1))
    assert sum(n for _, n in got) == 40_000 and time.process_time() - at < 5


@pytest.mark.parametrize("text, want, offsets", [("not", [5], [(0, 3)]), ("note", [5, 3], [(0, 3), (3, 4)]), ("eton", [3, 2, 1, 0], None), ("", [], [])])
def test_encode(text, want, offsets):
    got = Bpe(NOTES, NOTES_MERGES).encode(text)
    assert ids(got) == want and (offsets is None or spans(got) == offsets)


def test_ignore_merges():
    m = Bpe(NOTES, NOTES_MERGES, Options(ignore_merges=True))
    assert ids(m.encode("no")) == [4] and ids(m.encode("note")) == [5, 3]


@pytest.mark.parametrize("fuse, text, want, offsets", [(True, "xy", [3], [(0, 2)]), (True, "xa", [3, 0], None), (True, "中国", [3], [(0, 6)]), (False, "xy", [3, 3], [(0, 1), (1, 2)])])
def test_unknown(fuse, text, want, offsets):
    got = Bpe(UNK, (("a", "b"),), Options(unk_token="<unk>", fuse_unk=fuse)).encode(text)
    assert ids(got) == want and (offsets is None or spans(got) == offsets)


def test_byte_fallback():
    every = {f"<0x{b:02X}>": b for b in range(256)}
    got = Bpe(every, (), Options(byte_fallback=True)).encode("中")
    assert ids(got) == [0xE4, 0xB8, 0xAD] and spans(got)[-1] == (2, 3)
    assert ids(Bpe({"a": 0, "<0x62>": 100}, (), Options(byte_fallback=True)).encode("ab")) == [0, 100]
    assert Bpe({"<0x61>": 0}, ()).encode("x") == []


def test_suffix():
    v = {"r": 0, "o": 1, "u": 2, "d</w>": 3, "ro": 4, "nd</w>": 5, "round</w>": 6, "rou": 7, "n": 8}
    m = Bpe(v, (("r", "o"), ("n", "d</w>"), ("ro", "u"), ("rou", "nd</w>")), Options(end_of_word_suffix="</w>"))
    assert m.encode("round") == [(6, 5)]


def test_dropout_range_and_ends():
    for p in (-0.1, 2.0, 1.5):
        with pytest.raises(ValueError):
            Options(dropout=p)
    assert ids(Bpe(UNK, (("a", "b"),), Options(dropout=1.0)).encode("ab")) == [0, 1]
    assert ids(Bpe(UNK, (("a", "b"),), Options(dropout=0.0)).encode("ab")) == [5]


def test_resolution():
    m = Bpe({"a": 0, "b": 1, "ab": 2}, (("a", "x"), ("a", "b"), ("b", "a"), ("a", "b")))
    assert m.table == {(0, 1): (3, 2)} and m.merges_list() == [("a", "b")]
    with pytest.raises(ValueError):
        Bpe({"a": 0}, (("a", "b"),))
    assert m.token_to_id("ab") == 2 and m.id_to_token(1) == "b" and m.id_to_token(9) is None and m.vocab_size == 3


def test_rank_monotone():
    assert Bpe(NOTES, NOTES_MERGES).rank_monotone
    assert not Bpe({"a": 0, "b": 1, "ab": 2, "abb": 3}, (("ab", "b"), ("a", "b"))).rank_monotone

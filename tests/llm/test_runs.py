"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from graintable.llm import runs

from .conftest import ROWS

SF = "/root/testdata/sf0.001"


def all_runs(words):
    """Every run (start, end, smallest period) with two periods at least, by a scan of each period."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p:
                found.setdefault((i, j + p), p)  # smaller periods come first
            i = j
    return sorted((a, b, p) for (a, b), p in found.items())


def plain(words, least=6, exponent=4):
    return sorted((a, b - a, p) for a, b, p in all_runs(words) if b - a >= max(least, exponent * p))


def split(text):
    return (text or "").encode().split()


def tail(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = tail(doc_id, split(text))
    found = plain(words)
    gone = {i for a, size, p in found for i in range(a + p, a + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
        sha("".join(f"{a},{s},{p}\n" for a, s, p in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@pytest.mark.parametrize("kinds", [1, 2, 3, 5])
def test_all_runs_of_random_sequences(kinds):
    draw = random.Random(kinds)
    for n in [1, 2, 3, 5, 8, 13, 40, 120] * 6:
        s = [draw.randint(1, kinds) for _ in range(n)]
        if draw.random() < 0.5:
            p = draw.randint(1, 7)
            s += (s[:p] * n)[:n] + [draw.randint(1, kinds)] * draw.randint(0, 3)
        assert [tuple(r) for r in runs.runs_of(np.array(s)).tolist()] == all_runs(s)


def test_fibonacci_words():
    a, b = [1], [1, 2]
    for _ in range(11):
        a, b = b, b + a
    assert [tuple(r) for r in runs.runs_of(np.array(b)).tolist()] == all_runs(b)


def test_extensions_by_comparison():
    s = np.array([1, 2, 1, 2, 1, 1, 2, 1, 3, 1, 2, 1])
    tree = runs.Extensions(*runs.SuffixTree([*s.tolist(), 0], 4).tour())
    for i in range(len(s)):
        for j in range(len(s)):
            if i != j:
                k = 0
                while max(i, j) + k < len(s) and s[i + k] == s[j + k]:
                    k += 1
                assert tree(np.array([i]), np.array([j]))[0] == k


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (3, 3), (10, 4), (5, 6), (1, 4)])
def test_batches_leave_no_run_out(least, exponent):
    """Texts of few words, with runs planted, are cut to stretches without loss."""
    draw = random.Random(least * 10 + exponent)
    texts = []
    for _ in range(120):
        words = [f"w{int(draw.paretovariate(0.7)) % 40}" for _ in range(draw.randint(0, 150))]
        for _ in range(draw.randint(0, 3)):
            at, p = draw.randint(0, len(words)), draw.randint(1, 9)
            part = words[at : at + p] or ["z"]
            words[at:at] = (part * 8)[: draw.randint(1, 8 * len(part))]
        texts.append("\t ".join(words).encode())
    for text, (n, found, collapsed) in zip(texts, runs.RunFinder(least, exponent)(texts), strict=True):
        words = text.split()
        want = plain(words, least, exponent)
        assert n == len(words) and [tuple(r) for r in found.tolist()] == want
        gone = {i for a, size, p in want for i in range(a + p, a + size)}
        assert collapsed == b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_colliding_hashes_lose_nothing(monkeypatch):
    monkeypatch.setattr(runs, "TABLE_BITS", 2)
    text = b"a b c d e f " + b"x y z " * 5 + b"g h i j x y z k l m"
    assert [tuple(r) for r in next(runs.RunFinder(6, 4)([text]))[1].tolist()] == plain(text.split())


def test_query_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in runs.op12_runs(spark, SF).collect()}
    assert got == {expected(*r) for r in docs}
    assert sum(r[1] > 0 for r in got) > 10


def test_query_on_odd_rows(spark, odd, empty):
    got = Counter(tuple(r) for r in runs.op12_runs(spark, odd).collect())
    long = next(r[1] for r in ROWS if r[0] == 11)
    known = Counter(expected(r[0], r[1]) for r in ROWS if r[1] != long)
    (rest,) = (got - known).elements()
    assert not known - got
    words = split(long)
    assert rest[0] == 11 and rest[1] == 1 and rest[2:5] == (0, len(words), 1994) and rest[5] == 1000 * len(words) // 1994
    assert rest[7] == hashlib.sha256(b" ".join(words[:1994])).hexdigest()
    assert runs.op12_runs(spark, empty).count() == 0


def test_slices_and_keys_of_any_kind(spark, monkeypatch):
    rows = [(None, "x " * 9), ("k", "a b " * 10 + "end"), ("k", None), ("k", "a b " * 10 + "end")]
    df = spark.createDataFrame(rows, "name string, body string").repartition(1)
    got = Counter((r["name"], r["n_words"], r["collapsed"], len(r["runs"])) for r in runs.find_runs(df, "name", "body").collect())
    assert got == Counter([(None, 9, "x", 1), ("k", 21, "a b end", 1), ("k", 0, "", 0), ("k", 21, "a b end", 1)])


def test_keys_that_change_blank_texts(spark):
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, text) for i in ids for text in ("", " \n", None, "a", "a b c d e f g h i j")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r[0], tuple(split(r[1]))) for r in runs.with_tails(df).collect())
    assert got == Counter((i, tuple(tail(i, split(text)))) for i, text in rows)


def test_a_long_tail_is_not_quadratic(spark):
    key = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    words = [f"w{i}" for i in range(200_000)]
    (row,) = runs.with_tails(spark.createDataFrame([(key, " ".join(words))], "doc_id long, text string")).collect()
    assert row["text"].split() == tail(key, words)

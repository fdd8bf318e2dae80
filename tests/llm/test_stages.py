"""The pipeline's dedup stages on rows that repeat their key, their text or both, and on rows without a key."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline
from graintable.llm import exact_dedup, minhash

SCHEMA = "doc_id long, text string, source string, _extra string, rep int"
LONG = " ".join(f"word{i}" for i in range(60))
NEAR = LONG + " more"
ROWS = [
    (3, "the same", "a", "x", 1), (3, "the same", "a", "x", 1), (3, "the same", "b", None, 2), (7, "the  same\n", "a", "x", 1), (None, "the same", "a", "x", 1),
    (4, "another", "a", "x", 1), (4, "not the other", "a", "x", 1),
    (None, "no key", "a", "x", 1), (None, "no key", "a", "x", 1), (None, "no\tkey", "a", "y", 1),
    (None, None, None, None, None), (None, None, None, None, None), (9, "", "a", "x", 1), (9, None, "a", "x", 1),
    (1, LONG, "a", "x", 1), (1, LONG, "a", "x", 1), (2, NEAR, "a", "x", 1), (None, LONG + " end", "a", "x", 1),
    (20, LONG.replace("word", "w"), "a", "x", 1), (None, LONG.replace("word", "w") + " end", "a", "x", 1), (None, LONG.replace("word", "v"), "a", "x", 1), (None, LONG.replace("word", "v"), "a", "x", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def plain(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_exact_stage_leaves_one_row_of_each_text(spark, docs):
    out = corpus_pipeline.drop_exact_copies(spark, docs, "")
    rows = [tuple(r) for r in out.collect()]
    groups = defaultdict(list)
    for r in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r)
    left = {re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""): r for r in rows}
    assert out.columns == docs.columns and len(rows) == len(left) == len(groups) and set(left) == set(groups)
    for text, group in groups.items():
        keys = [r[0] for r in group if r[0] is not None]
        assert left[text] in group and left[text][0] == min(keys, default=None)
    assert plain(corpus_pipeline.drop_exact_copies(spark, docs.repartition(7), "")) == plain(out)


def test_near_stage_leaves_one_row_of_equal_rows(spark, docs):
    rows = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    long = [r for r in rows if r[1] and len(r[1]) > 100]
    assert sorted(map(str, ((r[0], r[1]) for r in long))) == sorted(map(str, [(1, LONG), (20, LONG.replace("word", "w")), (None, LONG.replace("word", "v"))]))
    assert sum(r[0] is None and r[1] == "no key" for r in rows) == 1 and sum(r[1] == "the same" for r in rows) == 1
    assert {r[1] for r in rows if r[0] == 4} == {"another", "not the other"}  # of one key, different texts


@pytest.mark.parametrize("op", [exact_dedup.deduplicated, minhash.deduplicated])
def test_all_rows_equal_and_none(spark, docs, op):
    assert op(docs.limit(0)).count() == 0
    hot = spark.range(20_000).selectExpr("5L AS doc_id", "'one text of several words in all rows' AS text", "'s' AS source")
    assert [tuple(r) for r in op(hot).collect()] == [(5, "one text of several words in all rows", "s")]

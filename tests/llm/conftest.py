from pathlib import Path

import duckdb
import pytest

LONG = " ".join(f"wort{i % 997} und" for i in range(60_000))  # a very long text
BASE = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))

#: doc_id, text, lang, source, n_chars and columns whose names operators use themselves
ROWS = [
    (0, "The cat sat on the mat. The dog ate the bone in the yard.", "en", "a", 57),
    (1, "the cat  sat\ton the mat. The dog ate the bone in the yard.", "en", "a", 57),
    (2, "The cat sat on the mat. The dog ate the bone in the yard.", "en", "b", 57),
    (3, "The cat\nsat on the mat. The dog ate the bone in the yard.", None, None, None),
    (4, None, "de", "b", 0),
    (5, "", "de", None, 0),
    (6, " \t\n\v\f\r ", "fr", "c", 7),
    (7, "1234 5678 !!! ???", None, "c", 17),
    (8, BASE, "en", "a", len(BASE)),
    (9, BASE + " gamma", "en", "b", len(BASE) + 6),
    (10, BASE.replace("alpha0", "omega"), "fr", "c", len(BASE)),
    (11, LONG, "de", "a", len(LONG)),
    (12, "a", None, "b", 1),
    (13, "a", "en", "c", 1),
    (14, "Ünïcödé Ωmega ΣΑΣ 日本語 😀 it's İ ½", "en", "d", 30),
    (14, "Ünïcödé Ωmega ΣΑΣ 日本語 😀 it's İ ½", "en", "d", 30),  # a repeated row
    (None, "The cat sat on the mat. The dog ate the bone in the yard.", "en", "a", 57),
    (None, None, None, None, None),
    (15, "<|endoftext|> a <|startoftext|>\x1cb " + "x" * 5000, "en", "d", 5030),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = {"key": "k", "size": 7, "kept": "no", "component": -1, "h": 3, "id": "id", "t": 0, "shard": 9, "threshold": 1, "rep": "r"}


def write(spark, path: Path, rows, schema=SCHEMA, extra=True, name="documents"):
    df = spark.createDataFrame(rows, schema)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(v) for c, v in EXTRA.items() if c not in df.columns})
    df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder with documents full of odd cases."""
    return write(spark, tmp_path_factory.mktemp("odd"), ROWS)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    write(spark, path, [], extra=False)
    write(spark, path, [], "vec_id long, embedding array<float>, label int", False, "embeddings")
    return write(spark, path, [], "page_id long, url string, html string", False, "pages")


def duck(path: str, sql: str):
    con = duckdb.connect()
    for p in Path(path).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')" if p.is_dir() else f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con.execute(sql)


def same(df, path: str, sql: str) -> None:
    """The DataFrame's rows are the SQL's, whatever their order."""
    got = duck(path, sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(map(key, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(key, got.fetchall()))

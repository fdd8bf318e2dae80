"""The price channel as a data source: what is pushed to it, which files it reads, and its rows against the plain filters."""

import json

import pytest
from pyspark.sql import functions as F

from graintable.operators import prices
from graintable.schemas import PRICE_QUERY
from graintable.sources import price_pages as pages
from graintable.sources.prices import price_records

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('pages')}/all"
    pages.write_price_pages(price_records(spark, SF), path, page=100, pages_a_file=5)
    return path


def ids(df, *names):
    return sorted(tuple(r) for r in df.select(*(names or ["record_id"])).collect())


def test_every_record_comes_back_once(spark, folder):
    names = ["channel", "record_id", "materialName", "price", "releaseDate"]
    assert ids(pages.fetch_prices(spark, folder), *names) == ids(price_records(spark, SF), *names)


def test_filters_are_pushed_and_files_left_out(spark, folder, capsys):
    met = (F.col("channel") == "zc_price") & (F.col("releaseDate") >= "1995-01-01") & (F.col("price") < 3000) & (F.length("materialName") % 2 == 0)
    spark.conf.set(pages.PUSHDOWN, "true")
    try:
        df = pages.price_source(spark, folder).filter(met)
        df.explain("formatted")
        parts, every = df.rdd.getNumPartitions(), pages.price_source(spark, folder).rdd.getNumPartitions()
    finally:
        spark.conf.set(pages.PUSHDOWN, "false")
    pushed = next(x for x in capsys.readouterr().out.splitlines() if x.startswith("PushedFilters"))
    assert all(x in pushed for x in ("EqualTo(channel,zc_price)", "GreaterThanOrEqual(releaseDate,1995-01-01)", "LessThan(price,3000.0)"))
    assert parts * 2 < every
    assert ids(pages.fetch_prices(spark, folder, met)) == ids(price_records(spark, SF).filter(met)) != []
    either = (F.length("materialName") % 2 == 0) | (F.col("price") < 900)
    assert ids(pages.fetch_prices(spark, folder, either)) == ids(price_records(spark, SF).filter(either))


def test_what_is_fetched_can_be_used_in_many_ways(spark, folder):
    """One table filtered twice and not at all in one plan, with the setting on."""
    spark.conf.set(pages.PUSHDOWN, "true")
    try:
        rows = pages.fetch_prices(spark, folder)
        parts = [rows.filter("channel = 'zc_price'"), rows.filter("channel = 'information_price'"), rows]
        got = [p.count() for p in parts] + [parts[0].unionByName(parts[1]).count()]
        assert spark.conf.get(pages.PUSHDOWN) == "true"
    finally:
        spark.conf.set(pages.PUSHDOWN, "false")
    want = {r["channel"]: r["count"] for r in price_records(spark, SF).groupBy("channel").count().collect()}
    assert got == [want["zc_price"], want["information_price"], sum(want.values()), want["zc_price"] + want["information_price"]]


def test_rows_as_filter_prices(spark, folder):
    """A price query's conditions on the source, and the operator over plain records."""
    query = dict.fromkeys(f.name for f in PRICE_QUERY) | {"query_id": 1, "channel": "manufacturer_price", "province": "ASIA", "minPrice": 900.0, "maxPrice": 5000.0, "startReleaseDate": "1993-01-01", "endReleaseDate": "1996-12-31"}
    want = prices.filter_prices(price_records(spark, SF), spark.createDataFrame([query], PRICE_QUERY))
    met = (F.col("channel") == "manufacturer_price") & (F.col("province") == "ASIA") & F.col("price").between(900, 5000) & F.col("releaseDate").between("1993-01-01", "1996-12-31")
    assert ids(pages.fetch_prices(spark, folder, met)) == ids(want) != []
    asked = spark.createDataFrame([query], PRICE_QUERY)
    assert ids(prices.filter_prices(pages.fetch_prices(spark, folder), asked)) == ids(want)


def test_odd_pages(spark, tmp_path):
    record = {"record_id": "r", "price": 1.5, "materialName": None, "unknown": {"a": 1}}
    lines = [{"code": 200, "data": {"list": [record, {"record_id": None}]}}, {"code": 500, "message": "down"}, {"code": 200, "data": None}, {"code": 200, "data": {"list": None}}, {"code": 200, "data": {"list": []}}, {"data": {"list": [record]}}]
    place = tmp_path / "in" / "channel=a b"
    place.mkdir(parents=True)
    (place / "1.json").write_text("\n".join(map(json.dumps, lines)) + "\n")
    (place / "2.json").write_text("")
    read = lambda *conditions: pages.fetch_prices(spark, str(tmp_path / "in"), *map(F.expr, conditions))
    assert sorted(map(str, read().select("channel", "record_id", "price").collect())) == ["Row(channel='a b', record_id='r', price=1.5)", "Row(channel='a b', record_id=None, price=None)"]
    counts = {"price is null": 1, "price is not null": 1, "channel = 'other'": 0, "price <> 1.5": 0, "record_id in ('r', 'q')": 1, "record_id <=> null": 1, "price = 1": 0, "not (price > 1)": 0, "not (price <=> 1.5)": 1, "channel in ('a b', 'c')": 2}
    assert {c: read(c).count() for c in counts} == counts
    assert read("price > 1", "record_id = 'r'").count() == 1
    (tmp_path / "none").mkdir()
    assert pages.fetch_prices(spark, str(tmp_path / "none")).count() == 0


def test_records_without_a_channel_and_an_empty_table(spark, tmp_path):
    records = spark.createDataFrame([(None, "r1", 1.0), ("zc_price", "r2", None)], "channel string, record_id string, price double")
    pages.write_price_pages(records, f"{tmp_path}/a")
    assert ids(pages.fetch_prices(spark, f"{tmp_path}/a"), "channel", "record_id", "price") == [("zc_price", "r2", None)]
    pages.write_price_pages(records.limit(0), f"{tmp_path}/b")
    assert pages.fetch_prices(spark, f"{tmp_path}/b").count() == 0


def test_pages_are_made_where_the_records_are(spark, tmp_path, monkeypatch):
    """Nothing is written but the pages, in little space; pages are full, and hold each channel's records once."""
    records = price_records(spark, SF)
    folder = tmp_path / "pages"
    with monkeypatch.context() as m:
        m.setattr(pages, "durable", None)
        pages.write_price_pages(records, str(folder), page=50)
    n = records.count()
    assert sum(f.stat().st_size for f in folder.rglob("*.json*")) < 60 * n
    read = spark.read.schema("code int, channel string, data struct<totalCount int, list array<struct<record_id string>>>").json(str(folder))
    sizes = read.select("channel", "data.totalCount", F.size("data.list").alias("n")).collect()
    assert all(r["totalCount"] == r["n"] <= 50 for r in sizes) and sum(r["n"] for r in sizes) == n
    assert sum(r["n"] == 50 for r in sizes) > 0.9 * len(sizes)
    assert ids(read.select("channel", F.explode("data.list.record_id").alias("r")), "channel", "r") == ids(records, "channel", "record_id")

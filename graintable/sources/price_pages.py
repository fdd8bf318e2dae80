"""Price channels as a data source: pages of responses in files, asked with filters.

A channel's responses lie in folder/channel=<name>/, a response a line, each with a page of records, plain or in gzip. The format ``price_pages`` takes a task for each
file; filters on the channel leave out files before anything is read, and filters on other plain columns are applied to each block of a file, so Spark gets only the
rows that meet them. Spark doesn't test such filters again; all others it tests itself.

Spark keeps the filters that a Python source was last given with the source, not with the scan: a DataFrame that is filtered in two ways, or used with a filter
and without, gets the rows of the last filter in both (seen with 1,260 of 6,000 rows). So ``fetch_prices`` asks a source of its own once, with its conditions, and gives what it
wrote down; the setting by which Spark offers filters to Python sources is on for that write alone.

Responses whose code isn't 200, or without a list, give no rows. A folder without pages gives none. Memory is bounded by BLOCK, which a page (a line) must fit in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..durable import durable
from ..schemas import PRICE_RECORD, PRICE_RESPONSE

SCHEMA = T.StructType([T.StructField("channel", T.StringType()), *PRICE_RECORD.fields])
PAGE, FILE = 500, 200  # records of a page, pages of a file
BLOCK = 16 << 20
FORMAT, PUSHDOWN = "price_pages", "spark.sql.python.filterPushdown.enabled"
COMPARE = {ds.EqualTo: pc.equal, ds.GreaterThan: pc.greater, ds.GreaterThanOrEqual: pc.greater_equal, ds.LessThan: pc.less, ds.LessThanOrEqual: pc.less_equal}


def holds(condition: ds.Filter, column: pa.Array) -> pa.Array:
    """Whether each value meets a condition of a kind in ``understood``; null where that is unknown."""
    if isinstance(condition, ds.IsNotNull):
        return pc.is_valid(column)
    if isinstance(condition, ds.IsNull):
        return pc.is_null(column)
    if isinstance(condition, ds.In):
        return pc.and_kleene(pc.is_in(column, pa.array(list(condition.value), column.type)), pc.is_valid(column))
    return COMPARE[type(condition)](column, pa.scalar(condition.value, column.type))


def understood(condition: ds.Filter) -> bool:
    """A comparison of a plain column with a value that isn't null, a list of such values, or a test for null."""
    if isinstance(condition, (ds.IsNotNull, ds.IsNull)):
        return len(condition.attribute) == 1
    if isinstance(condition, ds.In):
        return len(condition.attribute) == 1 and all(v is not None for v in condition.value)
    return type(condition) in COMPARE and len(condition.attribute) == 1 and condition.value is not None


class Page(ds.InputPartition):
    """A file of a channel's pages."""

    def __init__(self, channel: str, path: str) -> None:
        super().__init__((channel, path))
        self.channel, self.path = channel, path


class PriceReader(ds.DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder, self.conditions = folder, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        for condition in filters:
            if understood(condition):
                self.conditions.append(condition)
            else:
                yield condition

    def _met(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        for condition in self.conditions:
            batch = batch.filter(holds(condition, batch.column(condition.attribute[0])))
        return batch

    def partitions(self) -> list[Page]:
        files, root = fs.FileSystem.from_uri(self.folder)
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        paths = sorted(f.path for f in found if f.is_file and f.size and f.base_name.endswith((".json", ".json.gz")))
        pages = [Page(unquote(p.rsplit("/", 2)[-2].removeprefix("channel=")), p) for p in paths if "/channel=" in p]
        asked = [c for c in self.conditions if c.attribute == ("channel",)]
        return [p for p in pages if all(holds(c, pa.array([p.channel], pa.string()))[0].as_py() for c in asked)]

    def read(self, partition: Page | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a source without a partition is read once
            return
        files, _ = fs.FileSystem.from_uri(self.folder)
        schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in PRICE_RESPONSE.fields])
        options = {"read_options": pj.ReadOptions(use_threads=False, block_size=BLOCK), "parse_options": pj.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore")}
        with files.open_input_stream(partition.path) as source, pj.open_json(source, **options) as blocks:
            for block in blocks:
                # flatten, unlike field, gives null where the struct is null
                pages = block.filter(pc.equal(block.column("code"), 200)).column("data").flatten()[1].flatten()
                columns = dict(zip([f.name for f in PRICE_RECORD.fields], pages.flatten(), strict=True))
                columns["channel"] = pa.array([partition.channel] * len(pages), pa.string())
                yield self._met(pa.RecordBatch.from_arrays([columns[f.name] for f in SCHEMA.fields], [f.name for f in SCHEMA.fields]))


class PriceChannel(ds.DataSource):
    """The format ``price_pages``; option path: the folder, as a URI or a path."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> PriceReader:
        return PriceReader(self.options["path"])


def price_source(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all pages as a source of its own: channel and the columns of PRICE_RECORD."""
    spark.dataSource.register(PriceChannel)
    return spark.read.format(FORMAT).load(folder)


def fetch_prices(spark: SparkSession, folder: str, *conditions: Column) -> DataFrame:
    """The records of all pages that meet the conditions, read once and written."""
    before = spark.conf.get(PUSHDOWN)
    spark.conf.set(PUSHDOWN, "true")
    try:
        return durable(reduce(DataFrame.filter, conditions, price_source(spark, folder)), "prices")
    finally:
        spark.conf.set(PUSHDOWN, before)


def write_price_pages(records: DataFrame, folder: str, page: int = PAGE, pages_a_file: int = FILE) -> None:
    """records: channel and columns of PRICE_RECORD. Responses of at most ``page`` records, by channel; records without a channel are left out, as no channel answers with them.

    A page is of records that lie together, so the task that has them makes it: nothing is shuffled, and only the pages are written, compressed."""
    given = [F.col(f.name) if f.name in records.columns else F.lit(None) for f in PRICE_RECORD.fields]
    rows = records.filter("channel is not null").select("channel", *[c.cast(f.dataType).alias(f.name) for c, f in zip(given, PRICE_RECORD.fields, strict=True)])

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pc.sort_indices(batch.column(0)))
            runs, pages = pc.run_end_encode(batch.column(0)), []
            ends = runs.run_ends.to_pylist()
            for channel, start, end in zip(runs.values.to_pylist(), [0, *ends], ends, strict=False):
                pages += [(channel, at, min(page, end - at)) for at in range(start, end, page)]
            channels, starts, counts = zip(*pages, strict=True)
            lists = pa.ListArray.from_arrays(pa.array([*starts, batch.num_rows], pa.int32()), pa.StructArray.from_arrays(batch.columns[1:], batch.schema.names[1:]))
            data = pa.StructArray.from_arrays([pa.array(counts, pa.int32()), lists], ["totalCount", "list"])
            yield pa.RecordBatch.from_arrays([pa.array(channels, pa.string()), pa.array([200] * len(pages), pa.int32()), pa.array(["ok"] * len(pages)), data], ["channel", *PRICE_RESPONSE.names])

    response = rows.mapInArrow(paged, T.StructType([T.StructField("channel", T.StringType()), *PRICE_RESPONSE.fields]))
    response.write.partitionBy("channel").option("maxRecordsPerFile", pages_a_file).option("compression", "gzip").json(folder)

"""Schemas of the tables that jobs read and write. Jobs never infer a schema."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, DOUBLE, LONG, INT = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def struct(**fields: T.DataType) -> T.StructType:
    """A struct of nullable fields. Built without a session, so that modules can be imported before there is one."""
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CHUNK = struct(doc_id=LONG, page_content=STRING, metadata=struct(type=STRING, chunk_id=INT, source=STRING))
PRICE_RECORD = struct(
    record_id=STRING, materialName=STRING, materialModelSpec=STRING, price=DOUBLE, taxRate=DOUBLE, unit=STRING, province=STRING, city=STRING,
    releaseDepartment=STRING, releaseTime=STRING, releaseDate=STRING, brand=STRING, supplyName=STRING, grade=STRING, label=STRING,
)
PRICE_RESPONSE = struct(code=INT, message=STRING, data=struct(totalCount=INT, list=T.ArrayType(PRICE_RECORD)))
PRICE_QUERY = struct(
    query_id=LONG, channel=STRING, materialName=STRING, materialModelSpec=STRING, brand=STRING, province=STRING, city=STRING, releaseDepartment=STRING,
    supplyName=STRING, grade=STRING, minPrice=DOUBLE, maxPrice=DOUBLE, startReleaseDate=STRING, endReleaseDate=STRING, matchMethod=INT, returnNumber=INT,
)
TURN = struct(session_id=STRING, turn=INT, ts=T.TimestampType(), user_input=STRING, entities=T.MapType(STRING, STRING), channel=STRING, channel_confidence=DOUBLE)
REQUEST = struct(request_id=LONG, ts=T.TimestampType(), kind=STRING, input_chars=LONG, output_tokens=LONG, ttft_s=DOUBLE, total_s=DOUBLE)

# fixed values: fields of a query in the order in which they are asked for
FILTER_FIELDS = ("materialName", "province", "city", "materialModelSpec", "startReleaseDate", "endReleaseDate", "minPrice", "maxPrice")
CHANNELS = ("information_price", "manufacturer_price", "zc_price")

"""WARC archives: written from a table, read back, segments put together.

Writing: the text writer's line separator is the blank lines that end a WARC record, so every task writes a valid archive, starting with a
``warcinfo`` record. Payloads are framed as chunked HTTP responses; a block of more than ``segment`` bytes is cut into a first record and
``continuation`` records that name it as their origin. Of equal payloads of ``least`` bytes or more the one with the smallest key is
archived, the others are ``revisit`` records that refer to it.

Reading: archives are cut where a line begins with ``WARC/1.``, by Spark's text reader, so a file is read by many tasks (gzipped files by one, as a
stream), and fields are taken from a record's head by functions. A payload may hold such a line itself. So every record's length is
compared with its Content-Length: if all those of a file agree, the cuts were right; a file with another length is read again from its start,
record after record, by one task (which holds that file).

Segments are grouped by origin and ordered by number. They must be numbered 1 to n, the last one must state the total length, and the lengths must
add up to it; then the chunked framing is taken off. Only segmented records are shuffled with their bytes, equal segments once.

Defined cases: a null payload is empty; a null key is written as no key and comes last in its group (a group without any key is all responses);
all rows of a group that bear its smallest key are responses; a repeated row gives the same record again; characters that no address holds are written as
percent codes, a null address as the record's name; an empty table gives an archive without records; extra columns are ignored. On
reading, ``problem`` says what is wrong with a record (null: nothing), and its payload is null.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import durable, shared_dir

LEAST, SEGMENT, CHUNK = 100, 16 << 10, 8 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
CUT = "\r\nWARC/1."  # no part of it is its own beginning: a reader that meets it in pieces can't miss it
LIMIT = 4 << 20  # bytes of payload a task hands over at once


# --- writing ----------------------------------------------------------------------------------------------------------------------


def record_name(key: str | None, digest: str) -> str:
    """The WARC-Record-ID of a payload under a key."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{digest}:{key}'.encode()).digest(), version=4)}>"


def _record(kind: str, name: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), *fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += (b"%x\r\n" % len(part), part, b"\r\n")
    return b"".join([*parts, b"0\r\n\r\n"])


def records_of(key: str | None, url: str | None, payload: bytes, digest: str, first: str | None, segment: int = SEGMENT, date: str = DATE) -> Iterator[bytes]:
    """The records of a page, without the blank lines behind each. ``first``: the key of the response that a revisit refers to, else null."""
    name = record_name(key, digest)
    fields = [("WARC-Date", date), ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else name[1:-1])]
    own = [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if key is not None:
        own.append(("Record-Key", quote(key, safe=" !#$&'()*+,/:;=?@[]~")))
    if first is not None:
        yield _record("revisit", name, [*fields, *own, ("WARC-Refers-To", record_name(first, digest)), ("WARC-Profile", PROFILE)], HTTP)
        return
    block = HTTP + chunked(payload)
    if len(block) <= segment:
        yield _record("response", name, fields + own, block)
        return
    yield _record("response", name, [*fields, *own, ("WARC-Segment-Number", "1")], block[:segment])
    for number, at in enumerate(range(segment, len(block), segment), 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if at + segment >= len(block) else []
        more = [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(number)), *total]
        yield _record("continuation", record_name(f"{key}:{number}", digest), fields + more, block[at : at + segment])


def write_warc(df: DataFrame, path: str, key: str, url: str, payload: str, least: int = LEAST, segment: int = SEGMENT, compression: str = "none") -> None:
    """``df`` as WARC files in the folder ``path`` (``compression``: none or gzip)."""
    rows = df.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # only digests and keys are grouped; a payload that nothing equals needs no row here
    groups = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    # written, its size is known before the join: payloads are shuffled only if the groups are too many to be sent to all
    known = rows.join(durable(groups.drop("n"), "warc-groups"), "digest", "left")
    revisits = F.when(~F.col("first").eqNullSafe(F.col("key")), F.col("first").cast("string"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for number, batch in enumerate(batches):
            if not number:
                out.append(_record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", [("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            for values in zip(*batch.columns, strict=True):
                for record in records_of(*(v.as_py() for v in values), segment=segment):
                    out.append(record)
                    size += len(record)
                if size > LIMIT:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = known.select(F.col("key").cast("string").alias("key"), "url", "payload", "digest", revisits.alias("first")).mapInArrow(build, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


# --- reading ----------------------------------------------------------------------------------------------------------------------


def field(head: Column, name: str) -> Column:
    """A field of a record's or response's head; null if there is none."""
    return F.nullif(F.rtrim(F.regexp_extract(head, rf"(?i)\r\n{name}[ \t]*:[ \t]*([^\r\n]*)", 1)), F.lit(""))


def _unfolded(head: Column) -> Column:
    return F.regexp_replace(head, r"\r\n[ \t]+", " ")


def _in_order(name: str, content: bytes) -> Iterator[tuple[str, bytes, str | None]]:
    """Head, block and problem of an archive's records, one after the other."""
    if name.endswith(".gz"):
        import gzip

        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        length = re.search(rb"(?i)\r\nContent-Length[ \t]*:[ \t]*(\d+)", content[at : max(end, at)])
        if end < 0 or not length or not content.startswith(b"WARC/1.", at):
            yield content[at : min(end if end >= 0 else len(content), at + 1000)].decode("utf-8", "replace"), b"", "no record head"
            return
        begin, stop = end + 4, end + 4 + int(length[1])
        yield content[at:end].decode("utf-8", "replace"), content[begin:stop], None if stop <= len(content) else "record cut off"
        at = stop
        while content.startswith(b"\r\n", at):
            at += 2


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, head, block, type, record_id and problem of every record under ``path``, continuation records by themselves."""
    text = spark.read.option("lineSep", CUT).text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter("value <> ''")
    head = F.substring_index("value", "\r\n\r\n", 1)
    cut = text.select("file", "value", _unfolded(head).alias("head"), F.octet_length(head).alias("_to")).withColumn("_length", F.expr(r"try_cast(regexp_extract(head, r'(?i)\r\nContent-Length[ \t]*:[ \t]*([0-9]+)', 1) as long)"))
    # behind the block are a line's end, and another one where the file ends
    rest = F.octet_length("value") - F.col("_to") - 4 - F.col("_length")
    odd = [r["file"] for r in cut.filter(F.coalesce(~rest.isin(2, 4), F.lit(True))).select("file").distinct().collect()]
    records = cut.filter(~F.col("file").isin(odd)) if odd else cut
    records = records.select("file", F.when(F.col("head").startswith("WARC/"), F.col("head")).otherwise(F.concat(F.lit("WARC/1."), "head")).alias("head"), F.expr("substring(cast(value as binary), _to + 5, cast(_length as int))").alias("block"), F.lit(None).cast("string").alias("problem"))
    if odd:
        whole = spark.read.format("binaryFile").load(odd).select("path", "content")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, content in zip(*batch.columns, strict=True):
                    for head, block, problem in _in_order(name.as_py(), content.as_py()):
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((name.as_py(), pa.string()), (head, pa.string()), (block, pa.binary()), (problem, pa.string()))], ["file", "head", "block", "problem"])

        again = whole.mapInArrow(read, "file string, head string, block binary, problem string")
        records = records.unionByName(again.withColumn("head", _unfolded(F.col("head"))))
    return records.withColumn("type", F.lower(field(F.col("head"), "WARC-Type"))).withColumn("record_id", field(F.col("head"), "WARC-Record-ID"))


def unchunk(body: bytes) -> bytes | None:
    """The payload of a body in chunked transfer framing; null if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"[ \t]*([0-9A-Fa-f]{1,15})[ \t]*(;.*)?", body[at : max(end, at)], re.DOTALL)
        if end < 0 or not size:
            return None
        n = int(size[1], 16)
        if not n:
            # trailing fields, if any, end with an empty line
            return b"".join(parts) if body.startswith(b"\r\n", end + 2) or body.find(b"\r\n\r\n", end + 2) > 0 else None
        begin, at = end + 2, end + 2 + n
        if not body.startswith(b"\r\n", at):
            return None
        parts.append(body[begin:at])
        at += 2


def http_payload(block: bytes) -> tuple[bytes | None, str | None]:
    """The payload of an HTTP response and, if it has none, the problem."""
    head, blank, body = block.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"HTTP/"):
        return None, "no response head"
    coding = re.search(rb"(?i)\r\nTransfer-Encoding[ \t]*:[ \t]*([^\r\n]*)", head)
    if not coding or b"chunked" not in coding[1].lower():
        return body, None
    found = unchunk(body)
    return found, "broken chunks" if found is None else None


def _decoded(records: DataFrame) -> DataFrame:
    """records: record_id, http, block, problem and others. The block becomes payload; problem says why there is none."""
    own = [c for c in records.columns if c not in ("block", "problem", "http")]
    schema = "".join(f"`{c}` {records.schema[c].dataType.simpleString()}, " for c in own) + "payload binary, problem string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, problems = [], []
            for http, block, problem in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("http", "block", "problem")), strict=True):
                said, raw = problem.as_py(), block.as_py()
                payload, why = (None, said) if said else http_payload(raw) if http.as_py() else (raw, None)
                payloads.append(payload)
                problems.append(why)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), pa.array(payloads, pa.binary()), pa.array(problems, pa.string())], [*own, "payload", "problem"])

    return records.mapInArrow(run, schema)


def reassemble(records: DataFrame) -> DataFrame:
    """From segments (of ``read_warc``): record_id of the first, block and problem; one row for each origin."""
    head = F.col("head")
    segments = records.select(
        F.coalesce(field(head, "WARC-Segment-Origin-ID"), "record_id").alias("record_id"),
        field(head, "WARC-Segment-Number").try_cast("long").alias("number"),
        field(head, "WARC-Segment-Total-Length").try_cast("long").alias("total"),
        "block",
        "problem",
    )
    # repeated records meet before the shuffle
    once = segments.groupBy("record_id", "number").agg(F.min("block").alias("block"), F.max("block").alias("_other"), F.max("total").alias("total"), F.max("problem").alias("problem"))
    part = F.struct("number", "block", (F.col("block") != F.col("_other")).alias("two"))
    whole = once.groupBy("record_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("total").alias("total"), F.count("total").alias("totals"), F.max("problem").alias("problem"), F.max_by("total", "number").alias("stated"))
    n = F.size("parts")
    block = F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["block"]))
    problem = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.exists("parts", lambda p: p["two"]), "two segments of one number")
        .when(~(F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1).cast("long"), n.cast("long"))), "segment missing")
        .when((F.col("totals") != 1) | F.col("stated").isNull(), "no total length")
        .when(F.aggregate("parts", F.lit(0), lambda s, p: s + F.octet_length(p["block"])).cast("long") != F.col("total"), "total length differs")
    )
    return whole.select("record_id", F.when(problem.isNull(), block).alias("block"), problem.alias("problem"))


def captures(records: DataFrame) -> DataFrame:
    """From ``read_warc``: record_id, type, key, target_uri, payload_digest, refers_to (a record's name), payload and problem of each response and revisit.
    A revisit's payload is null; a payload that isn't of its digest is a problem."""
    head = F.col("head")
    fields = records.select(
        "record_id", "type", "problem", "block", "head",
        # percent codes are read as written by ``records_of``
        F.try_url_decode(F.replace(field(head, "Record-Key"), F.lit("+"), F.lit("%2B"))).alias("key"),
        field(head, "WARC-Target-URI").alias("target_uri"),
        F.lower(F.regexp_extract(field(head, "WARC-Payload-Digest"), r"(?i)^sha256:([0-9a-f]{64})$", 1)).alias("payload_digest"),
        field(head, "WARC-Refers-To").alias("refers_to"),
        field(head, "WARC-Segment-Number").isNotNull().alias("_segment"),
        F.coalesce(F.lower(field(head, "Content-Type")).startswith("application/http"), F.lit(False)).alias("http"),
    )
    own = ["record_id", "type", "key", "target_uri", "payload_digest", "refers_to"]
    plain = _decoded(fields.filter("type = 'response' and not _segment").select(*own, "http", "block", "problem"))
    revisits = fields.filter("type = 'revisit'").select(*own, F.lit(None).cast("binary").alias("payload"), "problem")
    firsts = fields.filter("type = 'response' and _segment").select(*own, "http")
    joined = firsts.join(reassemble(fields.filter("_segment")), "record_id", "left")
    whole = _decoded(joined.select(*own, "http", "block", F.when(F.col("block").isNull(), F.coalesce("problem", F.lit("segment missing"))).alias("problem")))
    found = plain.unionByName(whole).unionByName(revisits)
    differs = F.coalesce((F.col("payload_digest") != "") & (F.sha2("payload", 256) != F.col("payload_digest")), F.lit(False))
    return found.withColumn("problem", F.when(differs, "payload digest differs").otherwise(F.col("problem"))).withColumn("payload", F.when(~differs, F.col("payload")))


def resolved(found: DataFrame) -> DataFrame:
    """From ``captures``, without payloads: key, type, target_uri, payload_bytes, payload_digest, refers_to (the response's key) and problem of each.
    A revisit's figures are those of the response that it refers to."""
    rows = durable(
        found.select("record_id", "type", "key", "target_uri", "refers_to", F.col("payload_digest").alias("stated"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).alias("payload_digest"), "problem"),
        "warc-captures",
    )
    revisits = rows.filter("type = 'revisit'")
    asked = revisits.select(F.col("refers_to").alias("record_id")).distinct()
    answers = rows.filter("type = 'response'").join(asked, "record_id", "left_semi").groupBy("record_id").agg(F.min(F.struct("key", "payload_bytes", "payload_digest", "problem")).alias("r"))
    joined = revisits.select("key", "type", "target_uri", "refers_to", "stated", "problem").join(answers.withColumnRenamed("record_id", "refers_to"), "refers_to", "left")
    problem = F.coalesce("problem", F.when(F.col("r").isNull(), "response missing"), "r.problem", F.when(F.col("stated") != F.col("r.payload_digest"), "payload digest differs"))
    return rows.filter("type = 'response'").select("key", "type", "target_uri", "payload_bytes", "payload_digest", F.lit(None).cast("string").alias("refers_to"), "problem").unionByName(
        joined.select("key", "type", "target_uri", "r.payload_bytes", "r.payload_digest", F.col("r.key").alias("refers_to"), problem.alias("problem"))
    )


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path, "page_id", "url", "html", compression="gzip")
    found = resolved(captures(read_warc(spark, path)))
    return found.select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to")
    )


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= {LEAST} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM g
"""

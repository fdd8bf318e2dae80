"""WARC archives: round trips, foreign and damaged archives, and the query against SQL."""

import gzip
import hashlib
from collections import Counter
from pathlib import Path

import pytest

from graintable.llm import warc

from .conftest import same, write

SF = "/root/testdata/sf0.001"
INNER = "see\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
SAME = "the same page " * 20
PAGES = [
    (5, "http://a.example/x?y=1 2\r\nWARC-Type: revisit", SAME),
    (3, "http://b.example/", SAME),
    (9, None, SAME),
    (None, "http://c.example/", SAME),
    (3, "http://b.example/", SAME),
    (1, "http://d.example/ü", None),
    (2, "", ""),
    (4, "http://e.example/", "short"),
    (6, "http://e.example/", "short"),
    (7, "http://f.example/", INNER * 30),
    (8, "http://g.example/", "\r\n\r\n" * 9000),
    (10, "http://h.example/", "日本語 😀 ü\r\n" * 3000),
    (11, "http://h.example/", "x" * 99),
    (12, "http://h.example/", "x" * 99),
    (13, "http://h.example/", "x" * 100),
    (14, "http://h.example/", "x" * 100),
    (None, "http://n.example/", "no key at all " * 20),
    (None, "http://n.example/", "no key at all " * 20),
    (-15, "http://o.example/", "0\r\n\r\n" + "big " * 40_000),
    (-15, "http://o.example/", "0\r\n\r\n" + "big " * 40_000),
]
SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize("extra", [True, False])
def test_odd_pages_match_sql(spark, tmp_path, extra):
    d = write(spark, tmp_path, PAGES, SCHEMA, extra, "pages")
    same(warc.op13_warc(spark, d), d, warc.ORACLE_SQL)


def test_query_on_given_and_empty_tables(spark, empty):
    same(warc.op13_warc(spark, SF), SF, warc.ORACLE_SQL)
    assert warc.op13_warc(spark, empty).count() == 0


def archive(spark, path, rows=PAGES, **options):
    warc.write_warc(spark.createDataFrame(rows, SCHEMA), f"{path}/a", "page_id", "url", "html", **options)
    return f"{path}/a"


@pytest.mark.parametrize(("segment", "compression", "split"), [(700, "none", "128m"), (700, "gzip", "128m"), (300, "none", "9k"), (16384, "none", "50k"), (1 << 30, "none", "1000")])
def test_round_trip(spark, tmp_path, segment, compression, split):
    """Payloads come back byte for byte, wherever files and blocks are cut."""
    path = archive(spark, tmp_path, segment=segment, compression=compression)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = warc.captures(warc.read_warc(spark, path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r["problem"] is None for r in found)
    got = Counter((r["key"], None if r["type"] == "revisit" else bytes(r["payload"])) for r in found)
    revisits = Counter({("5", None): 1, ("9", None): 1, (None, None): 1, ("14", None): 1})
    whole = Counter((None if k is None else str(k), (html or "").encode()) for k, _, html in PAGES)
    for lost in [("5", SAME), ("9", SAME), (None, SAME), ("14", "x" * 100)]:
        whole[lost[0], lost[1].encode()] -= 1
    assert got == +whole + revisits


def test_files_are_archives(spark, tmp_path):
    """Read by a plain loop over lengths: kinds, names, digests, numbers of segments."""
    path, kinds, names = archive(spark, tmp_path, segment=1000), Counter(), set()
    for file in Path(path).glob("part-*"):
        content = file.read_bytes()
        records = list(warc._in_order(file.name, content))
        assert records[0][0].split("\r\n")[1] == "WARC-Type: warcinfo"
        rebuilt = b"".join(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n" for head, block, _ in records)
        assert rebuilt == content and all(p is None for *_, p in records)
        for head, block, _ in records:
            fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
            assert len(fields) == head.count("\r\n") and {"WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length"} <= set(fields)
            assert fields["WARC-Block-Digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}" and len(block) <= 1000
            kinds[fields["WARC-Type"]] += 1
            names.add(fields["WARC-Record-ID"])
    assert kinds["revisit"] == 4 and kinds["response"] == 16 and kinds["continuation"] > 300
    repeated = 2 + len(range(1000, len(warc.HTTP + warc.chunked(("0\r\n\r\n" + "big " * 40_000).encode())), 1000)) + 1
    assert len(names) == kinds.total() - repeated


def record(kind, name, block, *fields, version="1.0"):
    head = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
CHUNKED = b"HTTP/1.1 200 OK\r\ntransfer-encoding:  gzip, Chunked\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    part = ["warc-segment-origin-id:<s>", "Content-Type: application/http"]
    foreign = [
        record("response", "p", HTTP + b"\xff\x00plain", "content-type:\tApplication/HTTP; msgtype=response", "Record-Key: a%20b+c"),
        record("response", "c", CHUNKED + b"3;ext=1\r\nabc\r\nA \r\n0123456789\r\n0\r\nTrailer: t\r\n\r\n", "Content-Type: application/http"),
        record("metadata", "m", b"anything"),
        record("response", "raw", b"no http at all", "Content-Type: text/plain", version="1.1"),
        record("response", "folded", HTTP + b"f", "Content-Type:\r\n application/http", "WARC-Target-URI: http://a/"),
        record("continuation", "s3", b"ld", *part, "WARC-Segment-Number: 3", f"WARC-Segment-Total-Length: {len(HTTP) + 11}"),
        record("response", "s", HTTP + b"hello", "Content-Type: application/http", "WARC-Segment-Number: 1"),
        record("continuation", "s2", b" wor", *part, "WARC-Segment-Number: 2"),
    ]
    (tmp_path / "f.warc").write_bytes(b"".join(foreign[:4]))
    (tmp_path / "g.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in foreign[4:]))
    found = {r["record_id"]: r for r in warc.captures(warc.read_warc(spark, str(tmp_path))).collect()}
    assert {k: bytes(r["payload"]) for k, r in found.items()} == {"<p>": b"\xff\x00plain", "<c>": b"abc0123456789", "<raw>": b"no http at all", "<folded>": b"f", "<s>": b"hello world"}
    assert found["<p>"]["key"] == "a b+c" and found["<folded>"]["target_uri"] == "http://a/" and all(r["problem"] is None for r in found.values())


def test_damage_is_told(spark, tmp_path):
    http, seg = "Content-Type: application/http", lambda n, *more: ("WARC-Segment-Origin-ID: <%s>" % more[0], f"WARC-Segment-Number: {n}", *more[1:])
    total = f"WARC-Segment-Total-Length: {len(HTTP) + 2}"
    damaged = [
        record("response", "chunk", CHUNKED + b"5\r\nab\r\n0\r\n\r\n", http),
        record("response", "endless", CHUNKED + b"2\r\nab\r\n", http),
        record("response", "head", b"oops", http),
        record("response", "digest", HTTP + b"ab", http, f"WARC-Payload-Digest: sha256:{hashlib.sha256(b'x').hexdigest()}"),
        record("response", "gap", HTTP, http, "WARC-Segment-Number: 1"),
        record("continuation", "gap3", b"ab", *seg(3, "gap", total)),
        record("response", "long", HTTP + b"a", http, "WARC-Segment-Number: 1"),
        record("continuation", "long2", b"bc", *seg(2, "long", total)),
        record("response", "open", HTTP + b"a", http, "WARC-Segment-Number: 1"),
        record("continuation", "open2", b"b", *seg(2, "open")),
        record("response", "twice", HTTP + b"a", http, "WARC-Segment-Number: 1"),
        record("continuation", "twice2", b"b", *seg(2, "twice", total)),
        record("continuation", "twice2", b"c", *seg(2, "twice", total)),
        record("revisit", "lone", b"", "WARC-Refers-To: <nowhere>"),
        record("revisit", "poor", b"", "WARC-Refers-To: <digest>"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(damaged))
    (tmp_path / "b.warc").write_bytes(record("response", "good", HTTP + b"ab", http) + record("response", "cut", HTTP + b"abcdef", http)[:-9])
    (tmp_path / "c.warc").write_bytes(record("response", "fine", HTTP + b"ab", http) + b"rubbish\r\n\r\nmore")
    found = warc.captures(warc.read_warc(spark, str(tmp_path)))
    got = {r["record_id"]: (r["problem"], r["payload"] and bytes(r["payload"])) for r in found.collect()}
    assert got == {
        "<chunk>": ("broken chunks", None), "<endless>": ("broken chunks", None), "<head>": ("no response head", None), "<digest>": ("payload digest differs", None),
        "<gap>": ("segment missing", None), "<long>": ("total length differs", None), "<open>": ("no total length", None), "<twice>": ("two segments of one number", None),
        "<lone>": (None, None), "<poor>": (None, None), "<good>": (None, b"ab"), "<cut>": ("record cut off", None), "<fine>": (None, b"ab"),
    }
    assert sorted(r["problem"] for r in warc.resolved(found).filter("type = 'revisit'").collect()) == ["payload digest differs", "response missing"]
    assert warc.read_warc(spark, f"{tmp_path}/c.warc").filter("problem = 'no record head'").count() == 1


def test_chunks():
    for size in (1, 3, 8192):
        for payload in (b"", b"a", b"\r\n0\r\n\r\n" * 5, bytes(range(256)) * 9):
            assert warc.unchunk(warc.chunked(payload, size)) == payload
    for bad in (b"", b"g\r\n", b"-1\r\n\r\n", b"1\r\na", b"0\r\n", b"5\r\nabc\r\n0\r\n\r\n"):
        assert warc.unchunk(bad) is None

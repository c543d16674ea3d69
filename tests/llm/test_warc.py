import gzip
import hashlib
import random

import pytest

from relrank.llm import warc
from relrank.llm.common import stage_path
from relrank.llm.queries import QUERIES

LONG = "<p>a payload of more than a hundred bytes, äöü 你好 🙂, which several pages share</p>" * 3
PAGES = [
    (3, "http://a/3", LONG),
    (1, "http://a/1", LONG),
    (1, "http://a/1", LONG),
    (None, "http://a/n", LONG),
    (4, "http://a/4\r\nWARC-Type: x", "short"),
    (5, None, "short"),
    (6, "http://a/6", None),
    (7, "http://a/7", ""),
    (8, "http://a/8", "x" * 99),
    (9, "http://a/9", "x" * 99),
    (-10, "http://a/10", "x" * 100),
    (11, "http://a/11", "x" * 100),
    (12, "http://a/12", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "z" * 200),
    (13, "http://a/13", "random " + "".join(chr(random.Random(1).randrange(32, 0x2FF)) for _ in range(300_000))),
]
SCHEMA = "page_id long, url string, html string, record_type string, path string, digest string, first string, n string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*row, *["mine"] * 5) for row in PAGES], SCHEMA).coalesce(1)


def brute(rows):
    groups = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100:
            groups.setdefault(data, []).append(i)
    found = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [x for x in groups.get(data, [i]) if x is not None]
        first = min(ids) if ids else None
        again = i != first
        found.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(found, key=repr)


def result(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def test_round_trip(pages):
    assert result(warc.round_trip(pages)) == brute(PAGES)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_query_against_brute_force(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert result(QUERIES["op12_warc"](spark, "/root/testdata/sf0.01")) == brute(rows)


@pytest.fixture(scope="module", params=[True, False], ids=["gzip", "plain"])
def archive(request, spark, pages):
    """The bytes of an archive of all pages, and the places of its records."""
    manifest = warc.write_archives(pages, stage_path(spark), compress=request.param).collect()
    assert len(manifest) == 1 and manifest[0].records == len(PAGES) + 1
    data = open(manifest[0].path.removeprefix("file://").removeprefix("file:"), "rb").read()
    assert len(data) == manifest[0].bytes
    whole = gzip.decompress(data) if request.param else data
    assert whole.count(b"\r\nContent-Type: application/http") == len(PAGES)  # an ordinary reader sees the same
    return data, found_in(spark, data)


def found_in(spark, data):
    rows = warc.read_archives(spark.createDataFrame([("x", bytearray(data))], "path string, content binary")).collect()
    at = 0
    for start, end in sorted({(r.start, r.end) for r in rows if r.start != r.end}):
        assert start == at  # records and gaps leave nothing out
        at = end
    assert at == len(data)
    return rows


def test_payloads_and_fields(archive):
    _, rows = archive
    assert all(r.problem is None for r in rows)
    by_id = {r.record_id: r for r in rows}
    assert by_id["urn:page:12"].payload.decode() == PAGES[12][2] and by_id["urn:page:13"].payload.decode() == PAGES[13][2]
    assert by_id["urn:page:3"].payload is None and by_id["urn:page:3"].refers_to == "urn:page:1"
    assert by_id["urn:page:4"].target_uri == "http://a/4%0D%0AWARC-Type: x" and by_id["urn:page:5"].target_uri is None
    assert by_id["urn:page:6"].payload == b"" and by_id["urn:page:"].record_type == "revisit"


def ids(rows):
    """Names of the records that were read; what stands inside a damaged payload may have none."""
    return sorted(r.record_id or "" for r in rows if r.problem is None)


def test_damage(spark, archive):
    data, rows = archive
    records = sorted((r for r in rows), key=lambda r: r.start)
    draw = random.Random(4)
    for hit in records:
        broken = bytearray(data)
        broken[hit.end - draw.randrange(1, 8)] ^= 0x5A
        found = found_in(spark, bytes(broken))
        assert [i for i in ids(found) if i] == sorted(r.record_id for r in records if r is not hit)
        gaps = [r for r in found if r.problem]
        assert gaps and all(hit.start <= g.start and g.end <= hit.end for g in gaps)
    # Bytes lost from the middle, garbage between records, a cut end.
    two, three = records[3], records[4]
    cut = data[: two.start + 20] + data[two.end :]
    assert ids(found_in(spark, cut)) == sorted(r.record_id for r in records if r is not two)
    mixed = data[: three.start] + b"noise \x1f\x8b\x08 WARC/1.0 noise" + data[three.start :]
    found = found_in(spark, mixed)
    assert ids(found) == ids(rows)
    assert [(r.start, r.end) for r in found if r.problem] == [(three.start, three.start + 24)]
    last = records[-1]
    found = found_in(spark, data[: last.end - 5])
    assert ids(found) == sorted(r.record_id for r in records if r is not last) and sum(r.problem is not None for r in found) == 1
    assert found_in(spark, b"") == [] and [r.problem for r in found_in(spark, b"only noise")] == ["header has no end"]


def test_one_member_for_all_records(spark, archive):
    data, rows = archive
    whole = gzip.compress(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    assert ids(found_in(spark, whole)) == ids(rows)
    broken = bytearray(whole)
    broken[-6] ^= 1  # the checksum: what was unpacked last does not count
    found = found_in(spark, bytes(broken))
    assert len(ids(found)) in (len(rows) - 1, len(rows) - 2) and [r.problem for r in found if r.problem] == ["member fails its check"]


def test_foreign_digests(spark):
    """Digests of other tools: base32, and algorithms that are not known."""
    import base64

    block = b"hello"
    sha1 = base64.b32encode(hashlib.sha1(block).digest()).decode()

    def record(digest):
        return warc._record([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Payload-Digest", digest)], block)

    rows = found_in(spark, record(f"sha1:{sha1}") + record("sha1:" + "A" * 32) + record("own:abc"))
    assert [(r.payload_digest, r.problem) for r in sorted(rows, key=lambda r: r.start)] == [
        (hashlib.sha1(block).hexdigest(), None),
        (None, "payload-digest differs"),
        ("abc", None),
    ]


def test_archives_are_rolled(spark, pages):
    manifest = warc.write_archives(pages, stage_path(spark), archive_bytes=1000).collect()
    assert len(manifest) > 3 and sum(r.records for r in manifest) == len(PAGES) + len(manifest)

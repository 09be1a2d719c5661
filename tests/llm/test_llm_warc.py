"""Archives written and read back: records, ranges of all sizes, false starts, broken members."""

import base64
import gzip
import hashlib
import zlib

import pytest

from quarry.llm import warc
from quarry.sources.ranged import listing

SCHEMA = "page_id long, url string, html string, id int, digest string, size int, record_type string"
PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "http://a/b c\r\nX: y", ""), (5, "http://ü/5", "ß" * 1000), (6, "", "x\x1f" * 30), (None, "n", "<p>one</p>"), (None, "m", "no id at all"),
    (7, "u", "WARC/1.1\r\n\r\nlike a header"), (8, "u", "long " * 300_000), (9, "u", "long " * 300_000), (2, "http://a/2", "<p>one</p>"), (1, "http://a/1", "<p>one</p>"),
]


def plain(rows):
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    out = []
    for i, _, h in rows:
        body, first = (h or "").encode(), least.get(h or "")
        again = first is not None and i != first
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [37, 1000, 1 << 20])
def test_round_trip(spark, split):
    df = spark.createDataFrame([(*p, 1, "x", 2, "y") for p in PAGES if split > 37 or len(p[2] or "") < 10_000], SCHEMA).repartition(3)
    found = warc.round_trip(df, split=split)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain([(r.page_id, r.url, r.html) for r in df.collect()])


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_payloads_targets_and_short_ones(spark, tmp_path):
    df = spark.createDataFrame([p for p in PAGES if p[0] is not None], "page_id long, url string, html string").repartition(2)
    folder = str(tmp_path / "out")
    manifest = warc.write(df, folder, "page_id", "url", "html", least_bytes=100, date="2024-01-01T00:00:00Z")
    assert manifest.agg({"records": "sum"}).first()[0] == 11
    rows = warc.read_folder(spark, folder, with_payload=True).collect()
    assert sorted((r.record_id, r.refers_to) for r in rows if r.record_type == "revisit") == [("9", "8")]  # shorter payloads are all written
    by = {r.record_id: r for r in rows}
    assert by["5"].payload.decode() == "ß" * 1000 and by["9"].payload is None and by["9"].payload_bytes == len("long " * 300_000) and by["3"].target is None
    assert by["4"].target == "http://a/b%20c%0D%0AX:%20y" and by["5"].target == "http://ü/5" and all(r.digest_holds for r in rows if r.record_type == "response")
    for f in (tmp_path / "out").glob("*.warc.gz"):  # other readers see plain gzip
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: ")


def member(key, payload, level=6):
    body = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x-record:%s>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (key.encode(), len(payload), payload)
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(body) + squeeze.flush()


def test_archives_inside_archives_and_broken_members(spark, tmp_path):
    inner = b"".join(member(f"inner{k}", bytes([k]) * 50) for k in range(40))
    broken = bytearray(member("broken", b"z" * 500 + bytes(range(256)) * 4, 0))
    broken[-200] ^= 255
    two = b"".join(gzip.decompress(member(f"both{k}", b"b")) for k in range(2))
    good = member("a", b"first") + member("outer", inner, 0) + member("b", b"second") + gzip.compress(two) + gzip.compress(b"no record") + bytes(broken) + b"junk" + member("c", b"") + member("cut", b"q" * 5000, 0)[:-900]
    (tmp_path / "x.warc.gz").write_bytes(good)
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    files = listing(spark, str(tmp_path), "*.warc.gz").select("path", "length")
    for split in (64, 300, 1 << 20):
        rows = warc.read(files, split, with_payload=True).collect()
        assert sorted(r.record_id for r in rows if r.error is None) == ["a", "b", "both0", "both1", "c", "outer"], split
        assert sum(r.error is not None for r in rows) == 2
        assert next(bytes(r.payload) for r in rows if r.record_id == "outer") == inner

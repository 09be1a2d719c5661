"""WARC archives: written by tasks, one gzip member for each record, and read back by byte ranges.

Writing. Payloads are grouped by digest with partial sums; the smallest id of each group is the response, all others become
revisits that refer to it and hold no payload. Every task writes a file of its own under a name that is used once, and its row
of the manifest names it. The manifest is a committed table, so files of lost or repeated attempts are in no manifest and
are never read.

Reading. Files are cut into byte ranges, whatever is in them. A task looks for the gzip magic from the start of its range,
decompresses each candidate's beginning, and takes it as a record if that is a WARC header. It owns the members that start inside
its range and reads the last one beyond the end. A candidate inside another member (an archive stored in a record without
compression) would look like a record: every range also tells how far its last member reached, and what starts before
the reach of the ranges in front of it is dropped.

Defined results: a null payload is empty; null ids make no row smaller and are written as empty; rows that share the smallest id
of their payload are all responses; a null target is left out; control characters and spaces of targets are percent-encoded;
a member with a readable header that ends early or is corrupt gives a row with `error`, and reading goes on behind its first byte.
Empty tables give no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.batches import pieces
from quarry.operators.joins import join_totals
from quarry.session import materialize, scratch_dir
from quarry.sources.ranged import byte_ranges, file_system, listing, opened

LEAST_BYTES = 0  # payloads from here on are revisited
BROADCAST_ROWS = 100_000
SPLIT, BLOCK, HEADER_MOST = 32 << 20, 1 << 18, 1 << 20
MAGIC, LEVEL = b"\x1f\x8b\x08", 6
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "path string, offset long, record_id string, record_type string, target string, refers_to string, payload_digest string, payload_bytes long, digest_holds boolean, error string"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(key: str | None) -> str:
    return f"<urn:x-record:{key or ''}>"


def record_bytes(kind: str, key: str | None, target: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_uri(key)}", f"WARC-Date: {date}"]
    if target is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", target))
    lines.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {record_uri(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode("utf-8", "surrogatepass")) + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def revisits(keyed: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(id, digest, first) of the rows (id, digest, size) that revisit the smallest id of their payload."""
    some = keyed.where(F.col("size") >= least_bytes)
    firsts = some.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    return join_totals(some.select("id", "digest"), firsts, ["digest"], keyed.count()).where("id IS NULL OR id <> first").distinct()


def write(df: DataFrame, path: str, id_col: str, target_col: str, payload_col: str, least_bytes: int = LEAST_BYTES, date: str | None = None) -> DataFrame:
    """The written manifest (path, length, records) of the archives in folder `path`. Payloads are strings or binary."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = df.select(F.col(id_col).alias("id"), F.col(target_col).cast("string").alias("target"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha2("payload", 256)), "size": F.octet_length("payload").cast("long")})
    again = materialize(revisits(rows.select("id", "digest", "size"), least_bytes), "revisits")
    met = again.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("first").cast("string").alias("refers_to"))
    met = F.broadcast(met) if again.count() <= BROADCAST_ROWS else met
    placed = rows.join(met, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    placed = placed.select(F.col("id").cast("string").alias("id"), "target", "payload", "refers_to")
    system, folder = file_system(path)
    system.create_dir(folder, recursive=True)

    def run(batches):
        name, records, out, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, None, file_system(path)[0]
        length = 0
        for b in pieces(batches):
            out = out or at.open_output_stream(name, compression=None)
            for key, target, payload, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                member = record_bytes("response" if refers is None else "revisit", key, target, payload, refers, date)
                out.write(member)
                length, records = length + len(member), records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path.rstrip("/") + name[len(folder.rstrip("/")) :]], "length": [length], "records": [records]})

    return materialize(placed.mapInArrow(run, "path string, length long, records long"), "manifest")


class Member:
    """The decompressed bytes of the gzip member at an offset, a piece at a time; `end` is where it stops in the file."""

    def __init__(self, file, offset: int):
        self.file, self.at, self.held, self.end = file, offset, b"", None
        self.unzip, self.fed = zlib.decompressobj(31), offset

    def more(self, read: int = BLOCK, most: int = BLOCK) -> bool:
        """Decompress up to `most` bytes into `held`; false at the end of the member. Raises zlib.error, or EOFError where the file stops."""
        if self.unzip.eof:
            return False
        data = self.unzip.unconsumed_tail
        if not data:
            self.file.seek(self.fed)
            data = self.file.read(read)
            self.fed += len(data)
            if not data:
                raise EOFError("the file ends inside a member")
        self.held += self.unzip.decompress(data, most)
        if self.unzip.eof:
            self.end = self.fed - len(self.unzip.unused_data)
        return True

    def header(self) -> dict[str, str] | None:
        """The next record's header, taken off `held`; None if what comes is no WARC header or nothing.

        It is read in small steps, so that an error later in the member doesn't hide it.
        """
        while b"\r\n\r\n" not in self.held:
            if len(self.held) >= 5 and not self.held.startswith(b"WARC/") or len(self.held) > HEADER_MOST or not self.more(2048, 32):
                return None
        if not self.held.startswith(b"WARC/"):
            return None
        head, self.held = self.held.split(b"\r\n\r\n", 1)
        pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
        return {k.strip().lower(): v.strip() for k, v in pairs}

    def take(self, n: int) -> bytes:
        """The next n bytes."""
        parts, have = [self.held], len(self.held)
        self.held = b""
        while have < n:
            if not self.more():
                raise EOFError("the member ends inside a record")
            parts.append(self.held)
            have += len(self.held)
            self.held = b""
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]


def _bare(uri: str | None) -> str | None:
    return None if uri is None else uri.strip("<>").removeprefix("urn:x-record:")


def parsed(head: dict[str, str], block: bytes, with_payload: bool) -> dict:
    """A record's fields. Payload is what follows the HTTP header; a revisit's length is the one its HTTP header states."""
    kind, payload, size, told = head.get("warc-type"), block, None, head.get("warc-payload-digest", "").rpartition(":")[2] or None
    if head.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if kind == "revisit" and (stated := re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", http)):
            size = int(stated[1])
    own = kind != "revisit"
    digest = payload_digest(payload) if own else told
    out = {
        "record_id": _bare(head.get("warc-record-id")), "record_type": kind, "target": head.get("warc-target-uri"), "refers_to": _bare(head.get("warc-refers-to")), "payload_digest": digest,
        "payload_bytes": len(payload) if own else size, "digest_holds": told == digest if own and told else None,
    }
    return out | ({"payload": payload if own else None} if with_payload else {})


def candidates(file, start: int, end: int) -> Iterator[int]:
    """Offsets of the gzip magic in [start, end). Send the offset at which to go on, or None for the next one."""
    at = start
    while at < end:
        file.seek(at)
        data = file.read(min(BLOCK, end - at) + len(MAGIC) - 1)
        found = data.find(MAGIC)
        if found < 0:
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        went = yield at
        at = went if went is not None else at + 1


def records_in(file, start: int, end: int, with_payload: bool = False) -> Iterator[dict]:
    """The records of the members that start in [start, end), then a row with `first` and `reach` of those members."""
    first, reach, search = None, None, candidates(file, start, end)
    at = next(search, None)
    while at is not None:
        member, go_on = Member(file, at), None
        try:
            head = member.header()
        except (zlib.error, EOFError):
            head = None
        if head is not None:
            first = at if first is None else first
            try:
                while head is not None:
                    block = member.take(int(head.get("content-length", 0)))
                    yield {"offset": at} | parsed(head, block, with_payload)
                    member.take(4)
                    head = member.header()
                while member.more():
                    member.held = b""
                go_on = reach = member.end
            except (zlib.error, EOFError, ValueError) as broken:
                yield {"offset": at, "error": str(broken)}
                reach = max(reach or 0, at + 1)
        try:
            at = search.send(go_on)
        except StopIteration:
            at = None
    if first is not None:
        yield {"offset": first, "first": first, "reach": reach}


def read(files: DataFrame, split: int = SPLIT, with_payload: bool = False) -> DataFrame:
    """RECORD (with `payload` if asked for) of all records in the archives `files` (path, length)."""
    spark = files.sparkSession
    fields = RECORD + (", payload binary" if with_payload else "")
    names = [f.split()[0] for f in (fields + ", start long, first long, reach long").split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n, types[f.split()[1]]) for n, f in zip(names, (fields + ", start long, first long, reach long").split(", "), strict=True)])
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = byte_ranges(files, split).repartition(parts, "path", "start")

    def run(batches):
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held, size = [], 0
                with opened(path) as file:
                    for r in records_in(file, start, end, with_payload):
                        held.append({"path": path, "start": start} | r)
                        size += len(r.get("payload") or b"") + 200
                        if size > BLOCK:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    found = materialize(ranges.mapInArrow(run, fields + ", start long, first long, reach long"), "records")
    before = F.max("reach").over(W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1))  # a row for each range of a file
    claims = found.where("first IS NOT NULL").select("path", "start", "first", before.alias("reached"))
    inside = materialize(claims.where("first < reached").select("path", "start", "reached"), "inside")  # ranges that begin inside a member
    records = found.where("first IS NULL")
    if not inside.isEmpty():
        records = records.join(inside, ["path", "start"], "left").where("reached IS NULL OR offset >= reached")
    return records.select(*[n for n in names if n not in ("start", "first", "reach")])


def read_folder(spark: SparkSession, path: str, split: int = SPLIT, with_payload: bool = False) -> DataFrame:
    """The records of all archives below a folder."""
    return read(listing(spark, path, "*.warc.gz").select("path", "length"), split, with_payload)


def round_trip(pages: DataFrame, id_col: str = "page_id", target_col: str = "url", payload_col: str = "html", split: int = SPLIT) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of each row, as read back from archives that hold the rows."""
    spark = pages.sparkSession
    back = read(write(pages, f"{scratch_dir(spark)}/archives", id_col, target_col, payload_col), split)
    kind = pages.schema[id_col].dataType
    as_id = lambda c: F.nullif(F.col(c), F.lit("")).cast(kind)
    broken = F.when(F.col("error").isNotNull() | ~F.coalesce("digest_holds", F.lit(True)), F.raise_error(F.concat_ws(" ", F.lit("unreadable record in"), "path", "offset", "error")))
    return back.where(broken.isNull()).select(as_id("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"))

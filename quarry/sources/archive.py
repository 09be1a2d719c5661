"""A data source for folders with ZIP archives: one row for each file and each archive member.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("archive").option("level", "hash").load(folder)

Options: `level` sets how much is read: directory (names, sizes, CRC32 of the central directory), hash (SHA-256 of every
file and member, in chunks) or content (the bytes, too). `members` is false to leave archives closed, `entry` names one
member ("outer.zip :: inner.txt") of which alone the content is read, `recursive` is false to stay in the folder.

Tests of path, kind, member, entry, size and crc32 prune the scan: folders that can't hold a wanted path aren't listed, and what
a test rules out by its name or its place in the central directory is neither opened nor read. They come in by the option
`where` (JSON, see `Wanted`), or, with the format "archive_pushed", from the query's own filters (`pushFilters`; needs
spark.sql.python.filterPushdown.enabled). Spark 4.1 keeps pushed filters with a loaded DataFrame, so a DataFrame of that format serves one query;
those of the format "archive" can be used again. For very many wanted locations, which are rows of a table, use `contents`; for very
many folders `tree`, which lists them in tasks.

Files are opened with ranged reads on every file system that pyarrow knows, so an archive's directory is read without the
bodies. Nothing fails a scan: a folder, file, archive or member that can't be read gives a row of kind "skipped" or "broken", or a
member row, with the error.

As a stream (`readStream`) the source delivers what it has not delivered yet, at most `budget` files and members a batch and at most
`total` in all. What each batch holds is written to a log in the folder `log` before it is read, so a restart repeats a batch that
was not finished and no other.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from quarry.session import materialize
from quarry.sources.ranged import entries, file_system, opened

SCHEMA = (
    "path string, kind string, member string, entry int, size long, compressed long, method int, flags int, extra_size int, comment_size int,"
    " crc32 string, sha256 string, modified timestamp, mtime_ns long, error string, content binary"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
CHUNK = 1 << 20
SHARES, MOST_SHARES = 16, 2048  # partitions of one folder's files, and of all folders where they are many
ARCHIVES = (".zip", ".cbz", ".epub")
LAST_NS = (1 << 63) - 1
DEPTH = 1000  # of folders in folders
FOUND = "path string, kind string, size long, modified timestamp, mtime_ns long, error string"
TAKEN = "location string, carried string, sha256 string, content binary, error string"


def is_noise(name: str) -> bool:
    """Members that archivers add."""
    low = name.lower()
    last = low.rsplit("/", 1)[-1]
    return low.startswith("__macosx/") or last in (".ds_store", "thumbs.db", "desktop.ini") or last.startswith("._")


def member_name(info: zipfile.ZipInfo) -> str:
    """The name as it was meant: names without the UTF-8 flag were written in a Korean code page."""
    if info.flag_bits & 0x800:
        return info.filename
    raw = info.filename.encode("cp437", "replace")
    for name in ("cp949", "euc-kr", "utf-8"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return info.filename


def clamped_ns(ns: int) -> int:
    """Times that don't fit into 64 bits count as 0."""
    return ns if -LAST_NS - 1 <= ns <= LAST_NS else 0


def timestamp(seconds: float) -> datetime.datetime | None:
    """UTC, or None where no calendar holds the time."""
    try:
        return datetime.datetime.fromtimestamp(seconds, datetime.UTC)
    except (OSError, OverflowError, ValueError):
        return None


def member_time(info: zipfile.ZipInfo) -> datetime.datetime | None:
    try:
        return datetime.datetime(*info.date_time, tzinfo=datetime.UTC)
    except ValueError:
        return None


def said(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def _row(**values) -> tuple:
    return tuple(values.get(c) for c in COLUMNS)


# --- what is wanted ----------------------------------------------------------------------------------------------------

COMPARED: dict[str, Callable] = {
    "=": lambda x, v: x == v, "in": lambda x, v: x in v, ">": lambda x, v: x > v, ">=": lambda x, v: x >= v, "<": lambda x, v: x < v, "<=": lambda x, v: x <= v,
    "starts": lambda x, v: x.startswith(v), "ends": lambda x, v: x.endswith(v), "holds": lambda x, v: v in x,
}
PUSHED = {
    ds.EqualTo: "=", ds.In: "in", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<=",
    ds.StringStartsWith: "starts", ds.StringEndsWith: "ends", ds.StringContains: "holds", ds.IsNull: "null", ds.IsNotNull: "there",
}


class Wanted:
    """Tests (column, comparison, value) of the columns that are known before anything is read; all must hold.

    Comparisons are those of COMPARED, and null and there, which take no value. A null passes null alone.
    """

    KNOWN = ("path", "kind", "member", "entry", "size", "crc32")

    def __init__(self, tests: Iterable[Sequence] = ()):
        self.tests: dict[str, list[Callable]] = {}
        self.paths: set[str] | None = None
        self.prefix = ""
        for t in tests:
            self.add(*t)

    def add(self, column: str, how: str, value=None) -> None:
        if column not in self.KNOWN or how not in (*COMPARED, "null", "there"):
            raise ValueError(f"no such test: {column} {how}")
        if how in ("null", "there"):
            self.tests.setdefault(column, []).append(lambda x: (x is None) == (how == "null"))
            return
        value = frozenset(value) if how == "in" else value
        self.tests.setdefault(column, []).append(lambda x: x is not None and COMPARED[how](x, value))
        if column == "path" and how in ("=", "in"):
            some = set(value) if how == "in" else {value}
            self.paths = some if self.paths is None else self.paths & some
        if column == "path" and how == "starts" and len(value) > len(self.prefix):
            self.prefix = value

    def passes(self, **known) -> bool:
        return all(test(value) for column, value in known.items() for test in self.tests.get(column, ()))

    def folder(self, folder: str) -> bool:
        """Whether a wanted path may lie in the folder or below it."""
        inside = folder.rstrip("/") + "/"
        return (inside.startswith(self.prefix) or self.prefix.startswith(inside)) and (self.paths is None or any(p.startswith(inside) for p in self.paths))


# --- reading -----------------------------------------------------------------------------------------------------------


def taken(source, keep: bool) -> tuple[str, bytes | None]:
    """SHA-256 and, where asked for, the bytes, read in chunks."""
    digest, kept = hashlib.sha256(), []
    while chunk := source.read(CHUNK):
        digest.update(chunk)
        if keep:
            kept.append(chunk)
    return digest.hexdigest(), b"".join(kept) if keep else None


def members_of(archive: zipfile.ZipFile, first: int = 0, last: int | None = None) -> Iterator[tuple[int, zipfile.ZipInfo]]:
    """The members proper among the entries [first, last)."""
    for k, info in list(enumerate(archive.infolist()))[first:last]:
        if not info.is_dir() and not is_noise(info.filename):
            yield k, info


def member_row(archive: zipfile.ZipFile, k: int, info: zipfile.ZipInfo, level: str, wanted: Wanted) -> dict | None:
    row = {
        "kind": "zip item", "member": member_name(info), "entry": k, "size": info.file_size, "compressed": info.compress_size, "method": info.compress_type,
        "flags": info.flag_bits, "extra_size": len(info.extra), "comment_size": len(info.comment), "crc32": f"{info.CRC:08x}", "modified": member_time(info),
    }
    if not wanted.passes(**{c: row[c] for c in ("member", "entry", "size", "crc32")}):
        return None
    if level != "directory":
        try:
            with archive.open(info) as source:
                row["sha256"], row["content"] = taken(source, level == "content")
        except Exception as e:  # noqa: BLE001  a broken member is a row, not a failed scan
            row["error"] = said(e)
    return row


def file_rows(path: str, info: fs.FileInfo, level: str, wanted: Wanted, members: bool = True, only_member: bool = False, first: int = 0, last: int | None = None) -> Iterator[tuple]:
    """A file's row, if its entries are read from the first on, and those of its members; only what is wanted is opened."""
    if not wanted.passes(path=path):
        return
    own = {"path": path, "size": info.size, "modified": timestamp(info.mtime_ns / 1e9), "mtime_ns": clamped_ns(info.mtime_ns)}
    if not only_member and first == 0 and wanted.passes(kind="file", size=info.size, member=None, entry=None, crc32=None):
        try:
            if level != "directory":
                with opened(path) as f:
                    own["sha256"], own["content"] = taken(f, level == "content")
            yield _row(kind="file", **own)
        except OSError as e:
            yield _row(path=path, kind="skipped", error=said(e))
            return
    inside, broken = wanted.passes(kind="zip item"), wanted.passes(kind="broken", member=None, entry=None, crc32=None, size=None)
    if not members or not path.lower().endswith(ARCHIVES) or not (inside or broken):
        return
    try:
        with opened(path) as f, zipfile.ZipFile(f) as archive:
            for k, entry in members_of(archive, first, last) if inside else ():
                if row := member_row(archive, k, entry, level, wanted):
                    yield _row(path=path, mtime_ns=own["mtime_ns"], **row)
    except Exception as e:  # noqa: BLE001  whatever a broken archive makes its reader say
        if broken:
            yield _row(path=path, kind="broken", modified=own["modified"], mtime_ns=own["mtime_ns"], error=said(e))


class Share(ds.InputPartition):
    """Every `of`-th file of each of the folders, from `at` on."""

    def __init__(self, folders: list[str], at: int, of: int):
        self.folders, self.at, self.of = folders, at, of


def bare(path: str) -> str:
    """Local paths without their scheme."""
    return file_system(path)[1] if path.startswith("file:") else path


class ArchiveReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.folder = bare(options.get("path", ""))
        self.level = options.get("level", "directory")
        self.members = options.get("members", "true") == "true"
        self.recursive = options.get("recursive", "true") == "true"
        self.outer, _, self.inner = options.get("entry", "").partition(" :: ")
        self.wanted = Wanted(json.loads(options.get("where", "[]")))
        if self.outer:
            self.wanted.add("path", "=", self.outer)
        if self.inner:
            self.wanted.add("member", "=", self.inner)

    def partitions(self) -> list[Share]:
        if self.wanted.paths is not None:
            roots = sorted({os.path.dirname(p) for p in self.wanted.paths if self.outer or p.startswith(self.folder.rstrip("/") + "/")})
            folders = [f for f in roots if self.outer or self.recursive or f == self.folder.rstrip("/")]
            return [Share([f], 0, 1) for f in folders]
        folders, below = [self.folder], [self.folder] if self.recursive else []
        while below:
            try:
                found = [p for p, i in entries(below.pop()) if i.type == fs.FileType.Directory and self.wanted.folder(p)]
            except OSError:
                continue  # told where its files are listed
            folders += found
            below += found
        if len(folders) * SHARES > MOST_SHARES:
            return [Share(folders[k::MOST_SHARES], 0, 1) for k in range(min(len(folders), MOST_SHARES))]
        return [Share([f], k, SHARES) for f in folders for k in range(SHARES)]

    def read(self, partition: Share) -> Iterator[tuple]:
        for folder in partition.folders:
            try:
                found = entries(folder)
            except OSError as e:
                if partition.at == 0:
                    yield _row(path=folder, kind="skipped", error=said(e))
                continue
            for path, info in found[partition.at :: partition.of]:
                if info.type == fs.FileType.File:
                    yield from file_rows(path, info, self.level, self.wanted, self.members, bool(self.inner))


class PushedReader(ArchiveReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Take what is known; Spark tests all rows again."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in PUSHED and len(column) == 1 and column[0] in Wanted.KNOWN:
                self.wanted.add(column[0], PUSHED[type(f)], getattr(f, "value", None))
            yield f


class ArchiveSource(ds.DataSource):
    """spark.read.format("archive"), spark.readStream.format("archive")."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def streamReader(self, schema) -> ArchiveStream:
        return ArchiveStream(dict(self.options))


class PushedArchiveSource(ArchiveSource):
    """spark.read.format("archive_pushed"): load it anew for each query."""

    @classmethod
    def name(cls) -> str:
        return "archive_pushed"

    def reader(self, schema) -> PushedReader:
        return PushedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
    spark.dataSource.register(PushedArchiveSource)


# --- as tables ---------------------------------------------------------------------------------------------------------


def tree(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """FOUND of all files below `root`, and of the folders that can't be listed. Each level of folders is listed by tasks."""
    types = pa.schema([("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("mtime_ns", pa.int64()), ("error", pa.string())])
    kinds = {fs.FileType.File: "file", fs.FileType.Directory: "folder"}

    def run(batches):
        for b in batches:
            for folder in b.column(0).to_pylist():
                try:
                    rows = [{"path": p, "kind": kinds[i.type], "size": i.size, "modified": timestamp((i.mtime_ns or 0) / 1e9), "mtime_ns": clamped_ns(i.mtime_ns or 0)} for p, i in entries(folder) if i.type in kinds]
                except OSError as e:
                    rows = [{"path": folder, "kind": "skipped", "error": said(e)}]
                yield pa.RecordBatch.from_pylist(rows, types)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    level, out = spark.createDataFrame([(bare(root),)], "path string"), None
    for _ in range(DEPTH):
        found = materialize(level.mapInArrow(run, FOUND), "level")
        files = found.where("kind <> 'folder'")
        out = files if out is None else out.unionByName(files)
        level = found.where("kind = 'folder'").select("path").repartition(parts, "path")
        if not recursive or level.isEmpty():
            break
    return out


def grouped(rows: Iterable[tuple], key: int) -> Iterator[list[tuple]]:
    """Runs of rows of equal keys."""
    held: list[tuple] = []
    for r in rows:
        if held and held[0][key] != r[key]:
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def read_wanted(rows: Iterable[tuple], keep: bool) -> Iterator[dict]:
    """TAKEN and `carried` of (location, path, inner, entry, carried) rows, of which those of a path follow each other: each path is opened once."""
    for same in grouped(rows, 1):
        path, files, inner = same[0][1], [r for r in same if not r[2]], [r for r in same if r[2]]
        whole = False
        try:
            with opened(path) as f:
                if files:
                    sha, content = taken(f, keep)
                    whole = True
                    yield from ({"location": r[0], "carried": r[4], "sha256": sha, "content": content} for r in files)
                if inner:
                    with zipfile.ZipFile(f) as archive:
                        listed = archive.infolist()
                        places = {member_name(i): k for k, i in reversed(list(enumerate(listed)))}
                        for location, _, name, entry, carried in inner:
                            try:
                                at = entry if entry is not None and entry < len(listed) and member_name(listed[entry]) == name else places[name]
                                with archive.open(listed[at]) as source:
                                    sha, content = taken(source, keep)
                            except Exception as e:  # noqa: BLE001  a broken member is a row
                                sha, content, error = None, None, said(e)
                            else:
                                error = None
                            yield {"location": location, "carried": carried, "sha256": sha, "content": content, "error": error}
        except Exception as e:  # noqa: BLE001  a broken file is a row for each of its locations
            yield from ({"location": r[0], "carried": r[4], "error": said(e)} for r in (inner if whole else same))


def contents(wanted: DataFrame, level: str = "content") -> DataFrame:
    """`wanted` (location, path, inner[, entry], ..) with sha256, content (null at level "hash") and error: only their files are opened, each once in a task.

    Items are dealt by ranges of path and member, so an archive of which very many members are wanted is many tasks'.
    """
    spark = wanted.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    others = [c for c in wanted.columns if c != "location"]
    entry = F.col("entry").cast("int") if "entry" in others else F.lit(None).cast("int")
    rows = wanted.select("location", "path", F.coalesce("inner", F.lit("")).alias("inner"), entry.alias("entry"), F.to_json(F.struct(*others)).alias("carried"))
    dealt = rows.repartitionByRange(parts, "path", "inner").sortWithinPartitions("path", "entry", "inner")
    types = pa.schema([("location", pa.string()), ("carried", pa.string()), ("sha256", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches):
        every = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held, size = [], 0
        for r in read_wanted(every, level == "content"):
            held.append(r)
            size += len(r.get("content") or b"") + 200
            if size > CHUNK:
                yield pa.RecordBatch.from_pylist(held, types)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, types)

    read = dealt.mapInArrow(run, TAKEN).withColumn("c", F.from_json("carried", wanted.select(*others).schema))
    return read.select("location", *(F.col(f"c.{c}").alias(c) for c in others), "sha256", "content", "error")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """The written manifest (path, members) of ZIP archives in `folder` from rows (archive, entry, member, content).

    Each archive is written by one task, member by member in the order of `entry`, under another name until it is whole; so a
    repeated task writes the same file again, and nobody sees half of one.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.select("archive", "entry", "member", F.col("content").cast("binary").alias("content")).repartition(parts, "archive").sortWithinPartitions("archive", "entry", "member")
    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)

    def run(batches):
        system, root = file_system(folder)
        name, archive, stream, n = None, None, None, 0

        def close():
            archive.close()
            stream.close()
            system.move(f"{root}/{name}.part", f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{name}"], "members": [n]})

        for b in batches:
            for at, _, member, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != name:
                    if archive is not None:
                        yield close()
                    name, n = at, 0
                    stream = system.open_output_stream(f"{root}/{name}.part", compression=None)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(zipfile.ZipInfo(member), content or b"", zipfile.ZIP_DEFLATED)
                n += 1
        if archive is not None:
            yield close()

    return materialize(ordered.mapInArrow(run, "path string, members long"), "archives")


# --- as a stream -------------------------------------------------------------------------------------------------------


class Piece(ds.InputPartition):
    """Entries [first, last) of files."""

    def __init__(self, pieces: list[tuple[str, int, int | None]]):
        self.pieces = pieces


class ArchiveStream(ds.DataSourceStreamReader):
    """Files that no earlier batch held, archives by entries. A batch is a file in the log: lines of (path, size, mtime_ns, first, last, entries).

    A file counts as new again if its size or time has changed. An archive is opened for its number of entries only when it is its turn.
    """

    def __init__(self, options: dict):
        self.reader = ArchiveReader(options)
        self.log, self.budget, self.total = options["log"].rstrip("/"), int(options.get("budget", "1000")), int(options.get("total", "0"))
        self.tasks = int(options.get("tasks", "8"))
        self.system, self.folder = file_system(self.log)
        self.seen: dict[tuple, tuple[int, int]] = {}  # of a file as it was: entries delivered, entries in all
        self.given, self.last = 0, -1
        self.system.create_dir(self.folder, recursive=True)
        for batch in sorted(int(i.base_name) for i in self.system.get_file_info(fs.FileSelector(self.folder)) if i.base_name.isdigit()):
            self._remember(self._logged(batch))
            self.last = batch

    def _logged(self, batch: int) -> list[list]:
        with self.system.open_input_stream(f"{self.folder}/{batch}", compression=None) as f:
            return [json.loads(line) for line in f.read().decode().splitlines()]

    def _remember(self, lines: list[list]) -> None:
        for path, size, ns, first, last, number in lines:
            self.seen[path, size, ns] = (last, number)
            self.given += last - first

    def _new(self, budget: int) -> list[list]:
        lines: list[list] = []
        for share in self.reader.partitions():
            for path, info in self._files(share):
                key = (path, info.size, clamped_ns(info.mtime_ns))
                first, number = self.seen.get(key, (0, -1))
                if first == number:
                    continue
                if number < 0:
                    number = self._entries(path)
                last = min(number, first + budget)
                lines.append([*key, first, last, number])
                budget -= last - first
                if budget <= 0:
                    return lines
        return lines

    def _files(self, share: Share) -> Iterator[tuple[str, fs.FileInfo]]:
        for folder in share.folders:
            try:
                yield from ((p, i) for p, i in entries(folder)[share.at :: share.of] if i.type == fs.FileType.File)
            except OSError:
                continue

    def _entries(self, path: str) -> int:
        """Items of a file: itself, or the entries of an archive."""
        if self.reader.members and path.lower().endswith(ARCHIVES):
            try:
                with opened(path) as f, zipfile.ZipFile(f) as archive:
                    return max(1, len(archive.infolist()))
            except Exception:  # noqa: BLE001  told when it is read
                return 1
        return 1

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        budget = self.budget if not self.total else min(self.budget, self.total - self.given)
        lines = self._new(budget) if budget > 0 else []
        if lines:
            name = f"{self.folder}/{self.last + 1}"
            with self.system.open_output_stream(f"{name}.part", compression=None) as f:
                f.write("\n".join(json.dumps(line) for line in lines).encode())
            self.system.move(f"{name}.part", name)
            self._remember(lines)
            self.last += 1
        return {"batch": self.last}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        lines = [(p, first, last if last < number else None) for batch in range(start["batch"] + 1, end["batch"] + 1) for p, _, _, first, last, number in self._logged(batch)]
        return [Piece(lines[k :: self.tasks]) for k in range(min(self.tasks, len(lines)))]

    def read(self, partition: Piece) -> Iterator[tuple]:
        for path, first, last in partition.pieces:
            system, inside = file_system(path)
            info = system.get_file_info(inside)
            if info.type == fs.FileType.NotFound:
                yield _row(path=path, kind="skipped", error="FileNotFoundError: gone")
            else:
                yield from file_rows(path, info, self.reader.level, self.reader.wanted, self.reader.members, bool(self.reader.inner), first, last)

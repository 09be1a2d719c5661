"""What the archive source opens: pushed filters, wanted locations, folders listed by tasks, batches of a stream."""

import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, StringStartsWith

from quarry.plans import commands
from quarry.sources import archive, items


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "other").mkdir()
    for k in range(6):
        (tmp_path / f"f{k}.txt").write_text(f"text {k}" * (k + 1))
    (tmp_path / "sub" / "deep" / "g.txt").write_text("deep")
    for name in ("a.zip", "sub/b.zip", "other/c.zip"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k in range(5):
                z.writestr(f"{name[0]}{k}.txt", f"member {k} " * 20 * (k + 1))
    (tmp_path / "bad.zip").write_bytes(b"no archive at all")
    return str(tmp_path)


@pytest.fixture()
def counted(monkeypatch):
    """Paths in the order in which they are opened, and bytes that are read, in this process."""
    seen = []
    real = archive.opened
    monkeypatch.setattr(archive, "opened", lambda uri: seen.append(uri) or real(uri))
    return seen


def rows_of(folder, filters=(), **options):
    reader = archive.PushedReader({"path": folder, **options})
    assert list(reader.pushFilters(list(filters))) == list(filters)
    rows = [dict(zip(archive.COLUMNS, r, strict=True)) for share in reader.partitions() for r in reader.read(share)]
    return reader, rows


def test_only_what_is_wanted_is_opened(folder, counted):
    _, rows = rows_of(folder, level="hash")
    assert len(rows) == 6 + 1 + 4 + 15 + 1 and len(counted) == 11 + 4
    counted.clear()
    _, rows = rows_of(folder, level="directory")
    assert len(rows) == 27 and len(counted) == 4  # archives only
    counted.clear()
    reader, rows = rows_of(folder, [In(("path",), (f"{folder}/f1.txt", f"{folder}/sub/b.zip")), EqualTo(("kind",), "zip item")], level="content")
    assert counted == [f"{folder}/sub/b.zip"] and {r["member"] for r in rows} == {f"s{k}.txt" for k in range(5)} and len(reader.partitions()) == 2
    counted.clear()
    _, rows = rows_of(folder, [EqualTo(("kind",), "file"), GreaterThanOrEqual(("size",), 30)], level="hash", )
    assert set(counted) == {r["path"] for r in rows} == {f"{folder}/{n}" for n in ("f4.txt", "f5.txt", "a.zip", "sub/b.zip", "other/c.zip")} and len(counted) == 5
    counted.clear()
    reader, rows = rows_of(folder, [StringStartsWith(("path",), f"{folder}/sub/")])
    assert {p.rsplit("/", 1)[-1] for share in reader.partitions() for p in share.folders} == {folder.rsplit("/", 1)[-1], "sub", "deep"} and {r["path"] for r in rows} == {f"{folder}/sub/b.zip", f"{folder}/sub/deep/g.txt"}
    counted.clear()
    _, rows = rows_of(folder, [EqualTo(("member",), "a3.txt")], level="hash")
    assert [r["member"] for r in rows if r["kind"] == "zip item"] == ["a3.txt"] and len(counted) == 3 + 1  # directories of the archives


def test_filters_reach_the_source(spark, folder):
    rows = items.scan(spark, folder, "hash")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for test in (f"path = '{folder}/a.zip'", "kind = 'broken'", "size > 500 AND member LIKE 'a%'", "member IS NULL AND path LIKE '%.txt'", "NOT kind = 'file'", "entry IN (1, 2) OR crc32 IS NULL"):
        pushed = spark.read.format("archive_pushed").option("level", "hash").load(folder).where(test)
        assert sorted((r.path, r.member or "") for r in pushed.collect()) == sorted((r.path, r.member or "") for r in rows.where(test).collect()), test


def test_tests_by_option(spark, folder):
    zips = items.scan(spark, folder, where=[("kind", "=", "file"), ("path", "ends", ".zip")])
    assert sorted(r.path for r in zips.where("size > 100").unionByName(zips.where("size < 100")).collect()) == sorted(f"{folder}/{n}" for n in ("a.zip", "sub/b.zip", "other/c.zip", "bad.zip"))
    assert items.scan(spark, folder, where=[("member", "in", ["a1.txt", "s2.txt"]), ("entry", "<", 2)]).select("member").collect() == [("a1.txt",)]
    with pytest.raises(ValueError):
        archive.Wanted([("sha256", "=", "x")])


def test_contents_of_wanted_locations(spark, folder, counted):
    found = items.items(items.scan(spark, folder))
    wanted = found.where("name IN ('f3.txt', 'a1.txt', 's4.txt', 's2.txt')").select("location", "path", "inner", "entry", F.length("name").alias("extra"))
    got = {r.location.removeprefix(folder + "/"): r for r in archive.contents(wanted.repartition(2)).collect()}
    assert bytes(got["f3.txt"].content) == b"text 3" * 4 and bytes(got["sub/b.zip :: s4.txt"].content) == b"member 4 " * 100 and got["a.zip :: a1.txt"].extra == 6 and len(got) == 4
    assert {r.sha256 for r in archive.contents(wanted, "hash").collect()} == {r.sha256 for r in got.values()} and archive.contents(wanted, "hash").where("content IS NOT NULL").count() == 0
    rows = sorted(((r.location, r.path, r.inner, r.entry, "{}") for r in wanted.collect()), key=lambda r: r[1])
    rows += [("x", f"{folder}/zz.zip", "gone", None, "{}"), ("y", f"{folder}/zzz.txt", "", None, "{}")]
    rows.insert(1, (rows[0][0] + "?", rows[0][1], "no such member", None, "{}"))
    counted.clear()
    read = {r["location"]: r for r in archive.read_wanted(rows, True)}
    assert len(counted) == 5 and len(set(counted)) == 5 and len(read) == 7 and sum(r.get("error") is not None for r in read.values()) == 3


def test_commands_fetch_what_they_need(spark, folder):
    bare, full = items.items(items.scan(spark, folder)), items.items(items.scan(spark, folder, "content"))
    fetched = []

    def fetch(wanted):
        fetched.append({r.location for r in wanted.select("location").collect()})
        return archive.contents(wanted)

    columns = ["location", "extension", "size", "sha", "copies", "grp"]
    for k in (0, 1):
        assert sorted(commands.content_duplicates(bare, k / 10, fetch).select(columns).collect()) == sorted(commands.content_duplicates(full, k / 10).select(columns).collect())
    assert fetched[0] and not any(p.endswith("f3.txt") for p in fetched[0])  # a size that occurs once
    want = {r.location: (r.keep, r.evidence, r.verdict) for r in commands.comprehensive(full).collect()}
    assert {r.location: (r.keep, r.evidence, r.verdict) for r in commands.comprehensive(bare, fetch=fetch).collect()} == want and want
    prints = lambda f, **o: sorted((r.location, r.fingerprint, r.keep) for r in commands.text_duplicates(f, 10, **o).collect())
    assert prints(bare, fetch=fetch) == prints(full) != []
    allowed = full.where("kind <> 'file' AND entry < 2").select("location")
    assert prints(bare, fetch=fetch, allowed=allowed) == prints(full, allowed=allowed) != [] and fetched[-1] == {r.location for r in allowed.collect()}


def test_folders_are_listed_by_tasks(spark, folder):
    found = {r.path.removeprefix(folder + "/"): r for r in archive.tree(spark, folder).collect()}
    assert set(found) == {*(f"f{k}.txt" for k in range(6)), "sub/deep/g.txt", "a.zip", "sub/b.zip", "other/c.zip", "bad.zip"} and found["f2.txt"].size == 18 and found["f2.txt"].modified is not None
    assert archive.tree(spark, folder, recursive=False).count() == 8
    assert [r.kind for r in archive.tree(spark, f"{folder}/absent").collect()] == ["skipped"]


def run(spark, folder, tmp, **options):
    archive.register(spark)
    stream = spark.readStream.format("archive").options(level="hash", log=f"{tmp}/log", **options).load(folder)
    batches = []
    query = stream.writeStream.foreachBatch(lambda df, n: batches.append([(r.path, r.member, r.kind) for r in df.collect()])).option("checkpointLocation", f"{tmp}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return batches


def test_a_stream_goes_on_where_it_stopped(spark, folder, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("stream")
    every = {(r.path, r.member, r.kind) for r in items.scan(spark, folder, "hash").collect()}
    first = run(spark, folder, tmp, budget="4", total="10")
    assert sum(len(b) for b in first) <= 10 + 4 and all(len([r for r in b if r[1]]) <= 4 for b in first) and len(first) >= 3
    second = run(spark, folder, tmp, budget="1000")
    seen = [r for b in first + second for r in b]
    assert len(seen) == len(set(seen)) and set(seen) == every
    with zipfile.ZipFile(f"{folder}/new.zip", "w") as z:
        z.writestr("late.txt", "late")
    third = [r for b in run(spark, folder, tmp, budget="1000") for r in b]
    assert sorted(third, key=str) == sorted([(f"{folder}/new.zip", None, "file"), (f"{folder}/new.zip", "late.txt", "zip item")], key=str)
    assert run(spark, folder, tmp) == []

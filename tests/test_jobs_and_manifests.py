"""States of jobs, budgets, progress; manifests as files; moves; comparisons of books and stored texts."""

import threading
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.functions import content
from quarry.operators import manifest
from quarry.plans import compare
from quarry.sources import items
from quarry.sources.archive import clamped_ns, timestamp
from quarry.streaming import incremental, jobs


def test_job_states(spark, tmp_path):
    store = jobs.JobStore(spark, str(tmp_path / "state"))
    assert store.jobs().count() == 0 and store.resumed_from("k") is None and store.clear() == {"jobs": 0, "bad_paths": 0}
    store.note("k", "content", "/x", "running", 0, 10)
    store.note("k", "content", "/x", "partial", 4, 10, "/x/d", 1, "n" * 900)
    store.note("j", "titles", "/y", "done", 3, 3)
    assert {r.job_key: r.status for r in store.jobs().collect()} == {"k": "partial", "j": "done"} and [r.job_key for r in store.unfinished().collect()] == ["k"]
    assert store.resumed_from("k") == {"done": 4, "total": 10, "status": "partial", "last_path": "/x/d"} and store.resumed_from("j") is None
    assert [len(r.note) for r in store.jobs().where("job_key = 'k'").collect()] == [jobs.NOTE]
    with pytest.raises(ValueError):
        store.note("k", "c", "/", "lost")
    outcomes = spark.createDataFrame([("/x/a", 5, None, "io"), ("/x/b", 2, None, "absent"), ("/x/c", None, 1117, "device"), ("/x/d", None, None, None)], "path string, errno int, winerror int, error string")
    store.note_bad(jobs.bad_of(outcomes))
    store.note_bad(jobs.bad_of(outcomes).where("path = '/x/a'").withColumn("error", F.lit("again")))
    assert {r.path: r.error for r in store.bad_paths().collect()} == {"/x/a": "again", "/x/c": "device"}
    assert store.clear("k") == {"jobs": 1, "bad_paths": 0} and store.jobs().count() == 1 and store.bad_paths().count() == 2
    assert store.clear() == {"jobs": 1, "bad_paths": 2} and store.jobs().count() == 0


def test_cache_budget_and_bad_records(spark):
    records = spark.createDataFrame([(f"p{k}", k, 1, 1) for k in range(8)], "path string, size long, mtime_ns long, version int")
    cache = spark.createDataFrame([("p0", 0, 1, 1, "h0"), ("p1", 99, 1, 1, "stale")], "path string, size long, mtime_ns long, version int, hash string")
    bad = spark.createDataFrame([("p2",)], "path string")
    read = lambda df: df.select("*", F.concat(F.lit("h"), "size").alias("hash"), F.when(F.col("path") == "p3", 5).alias("errno"), F.lit(None).cast("int").alias("winerror"), F.when(F.col("path") == "p3", "io").alias("error"))
    keys = ["path", "size", "mtime_ns", "version"]
    results, cached, report = jobs.incremental_read(records, cache, keys, read, "path", budget=3, bad=bad)
    assert report == {"hits": 1, "misses": 3, "failed": 1, "skipped_known_bad": 1, "partial": {"reason": "budget", "read": 3, "limit": 3, "done": 4, "total": 8, "remaining": 3}}
    assert {r.path: r.hash for r in results.collect()} == {"p0": "h0", "p1": "h1", "p4": "h4"}
    results, _, report = jobs.incremental_read(records, cached, keys, read, "path")
    assert report["hits"] == 3 and "partial" not in report and results.count() == 7
    fresh = incremental.upsert(cache, spark.createDataFrame([("p1", 99, 1, 1, "new")], cache.schema), keys)
    assert {r.path: r.hash for r in fresh.collect()} == {"p0": "h0", "p1": "new"}
    stages = jobs.shared_budget([records.limit(3), records, records], "path", 5)
    assert [s.count() for s in stages] == [3, 2, 0]


def test_job_keys_and_errors(spark):
    df = spark.createDataFrame([(5, None), (None, 23), (2, None), (None, None)], "e int, w int")
    assert [r[0] for r in df.select(incremental.classify_error(F.col("e"), F.col("w"))).collect()] == ["device", "device", "benign", "benign"]
    key = lambda *o: spark.range(1).select(incremental.job_key(F.lit("c"), F.lit("/x"), *map(F.lit, o))).first()[0]
    assert len(key("a")) == 16 and key("a") != key("b") and key("a") == key("a")
    assert clamped_ns(43017417213000000000) == 0 and clamped_ns(5) == 5 and timestamp(1e18) is None


def test_rate(spark):
    rows = [("g", f"2024-01-01 00:00:{s:02d}", d) for s, d in ((0, 0), (2, 4), (4, 8), (10, 20), (30, 21), (59, 30))]
    df = spark.createDataFrame(rows, "g string, ts string, done long").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [r.rate for r in jobs.display_rate(df, "g", "ts", "done").orderBy("ts").collect()]
    assert got == [None, None, 2.0, 2.0, None, None]


def test_progress_and_stopping(spark, tmp_path):
    told = []
    listener = jobs.Progress(told.append)
    spark.streams.addListener(listener)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x")
    query = incremental.scan_new_files(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda batch, number: batch.count())
    query.awaitTermination()
    for _ in range(100):
        if any('"ended"' in t for t in told):
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert any('"started"' in t for t in told) and any('"progress"' in t for t in told)
    with jobs.Cancellable(spark) as running:
        threading.Timer(2, running.cancel).start()
        with pytest.raises(Exception, match="(?i)cancel"):
            spark.range(0, 400, 1, 4).mapInPandas(lambda it: (time.sleep(0.5) or p for p in it), "id long").repartition(4).mapInPandas(lambda it: (time.sleep(60) or p for p in it), "id long").count()
    assert spark.range(3).count() == 3


def test_manifest_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("alpha")
    (folder / "b.txt").write_text("alpha")
    with zipfile.ZipFile(folder / "z.zip", "w") as z:
        z.writestr("in/a.txt", "alpha")
        z.writestr("new.txt", "other")
    rows = items.scan(spark, str(folder), "content").cache()
    entries = manifest.scan_entries(rows)
    assert {(r.name, r.sha256 == "") for r in entries.collect()} == {("a.txt", False), ("b.txt", False), ("a.txt", True), ("new.txt", True)}
    manifest.save(entries.where("name <> 'new.txt' AND name <> 'b.txt'"), str(tmp_path / "m"), folder=str(folder))
    head, found = manifest.load(spark, str(tmp_path / "m"))
    assert head["folder"] == str(folder) and found.count() == 2
    checked = {r.location.removeprefix(str(folder) + "/"): (r.status, r.note) for r in manifest.check_scan(rows, found).collect()}
    assert checked == {"a.txt": ("self", ""), "b.txt": ("have", "SHA-256"), "z.zip :: in/a.txt": ("have", "SHA-256"), "z.zip :: new.txt": ("new", "")}
    assert manifest.check_counts(manifest.check_scan(rows, found)).first().asDict() == {"total": 4, "have": 2, "new": 1, "self": 1}
    assert manifest.check_scan(rows, found).orderBy(*manifest.check_order()).first().status == "have"
    weak = manifest.check_scan(rows, found.withColumn("sha256", F.lit(""))).where("location LIKE '%:: in/a.txt'").first()
    assert (weak.status, weak.note) == ("have", "size and CRC32")
    one = tmp_path / "one.jsonl"
    one.write_text('{"kind": "quarry-manifest", "version": 1}\n{"name": "x", "size": 1, "sha256": "s", "crc32": "c", "location": "l"}\n\n{broken\n')
    with pytest.raises(ValueError, match="line 4"):
        manifest.load(spark, str(one))
    one.write_text('{"name": "x"}\n')
    with pytest.raises(ValueError, match="no manifest"):
        manifest.load(spark, str(one))


def test_moves_never_meet(spark):
    paths = ["/r/1/a.txt", "/r/2/a.txt", "/r/3/a.txt", "/r/4/a (1).txt", "/r/5/b", "/r/6/b", "/r/7/a (1).txt", "/q/x", "/r/gone", "/r/8/c.txt"]
    wanted = spark.createDataFrame([(p, 1, "h") for p in paths], "location string, size long, sha256 string")
    now = spark.createDataFrame([(p, 1, "h") for p in paths if p != "/r/gone"], "location string, size long, sha256 string")
    existing = spark.createDataFrame([("c.txt",), ("c (1).txt",), ("a (2).txt",)], "name string")
    got = {r.location: (r.target, r.status) for r in manifest.verified_moves(wanted, now, "/r", "/t", existing).collect()}
    targets = [t for t, s in got.values() if s == "ready"]
    assert len(targets) == len(set(targets)) == 8 and not {"/t/c.txt", "/t/c (1).txt", "/t/a (2).txt"} & set(targets)
    assert got["/r/1/a.txt"] == ("/t/a.txt", "ready") and got["/r/4/a (1).txt"] == ("/t/a (1).txt", "ready") and got["/r/8/c.txt"] == ("/t/c (2).txt", "ready") and got["/r/2/a.txt"][0] == "/t/a (3).txt"
    assert got["/q/x"] == (None, "outside root") and got["/r/gone"] == (None, "missing")


PNG = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (3).to_bytes(4, "big") + (2).to_bytes(4, "big")
OPF = '<package xmlns:dc="d"><metadata><dc:title>T</dc:title><meta name="cover" content="c1"/></metadata><manifest><item id="c1" href="img/one.png" media-type="image/png"/></manifest></package>'


def book(path, members, method=zipfile.ZIP_DEFLATED, year=2020):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(zipfile.ZipInfo(name, (year, 1, 1, 0, 0, 0)), data, method)


def test_books(spark, tmp_path):
    page = "<p>" + "Same page of the book. " * 50 + "</p>"
    book(tmp_path / "a.epub", {"t.xhtml": page, "c.css": "x", "img/one.png": PNG, "old.txt": "moved", "only.txt": "1", "img/two.png": PNG + b"1"})
    book(tmp_path / "b.epub", {"t.xhtml": page, "c.css": "yz", "img/one.png": PNG, "new.txt": "moved", "pic/three.png": PNG + b"1"}, zipfile.ZIP_STORED, 2021)
    book(tmp_path / "c.epub", {"t.xhtml": page})
    book(tmp_path / "d.epub", {"t.xhtml": page}, zipfile.ZIP_STORED)
    rows = items.scan(spark, str(tmp_path), "content").cache()
    path = lambda n: str(tmp_path / n)
    pairs = spark.createDataFrame([("ab", path("a.epub"), path("b.epub"), 10, 20), ("cd", path("c.epub"), path("d.epub"), 5, 5)], "pair string, left string, right string, left_text int, right_text int")
    members = compare.compare_books(pairs, rows).cache()
    assert {(r.pair, r.name): r.status for r in members.collect()} == {("ab", "t.xhtml"): "same", ("ab", "c.css"): "changed", ("ab", "img/one.png"): "same", ("ab", "old.txt"): "left_only", ("ab", "only.txt"): "left_only", ("ab", "img/two.png"): "left_only", ("ab", "new.txt"): "right_only", ("ab", "pic/three.png"): "right_only", ("cd", "t.xhtml"): "same"}
    assert [r.recompressed for r in members.where("pair = 'cd'").collect()] == [True] and members.where("pair = 'ab' AND metadata_changed").count() == 2
    verdicts = {r.pair: r.verdict for r in compare.book_verdict(members).collect()}
    assert verdicts == {"ab": "changed members", "cd": "packaging only"}
    assert {(r.pair, *r.left_names, *r.right_names) for r in compare.renamed_members(pairs, rows).collect()} == {("ab", "old.txt", "new.txt"), ("ab", "img/two.png", "pic/three.png")}
    summary = compare.archive_summary(rows).cache()
    first = summary.where(F.col("path") == path("a.epub")).first()
    assert first.members == 6 and first.extensions == {".css": 1, ".png": 2, ".txt": 2, ".xhtml": 1} and first.categories["image"] == 2 and not first.broken and first.overhead == first.file_size - first.compressed_size
    assert {r.pair: r.recommended for r in compare.newer_side(pairs, summary).collect()} == {"ab": "right", "cd": "none"}
    images = compare.book_images(rows)
    assert {r.dimensions for r in images.collect()} == {"3x2"}
    aligned = {(r.left.member if r.left else None, r.right.member if r.right else None): (r.basis, r.status) for r in compare.aligned_images(pairs, images).collect()}
    assert aligned == {("img/one.png", "img/one.png"): ("path", "same"), ("img/two.png", "pic/three.png"): ("content", "same")}
    zips = compare.compare_zip_members(pairs, rows)
    assert zips.where("pair = 'cd' AND method_changed AND status = 'same'").count() == 1
    assert {r.pair: r.verdict for r in compare.archive_pair_verdict(zips, summary, pairs).collect()} == {"ab": "name lists differ", "cd": "other compression"}
    covers = rows.where("kind = 'file'").select(F.regexp_extract("path", "([^/]+)$", 1).alias("n"), content.cover("content", F.lit(".epub")).alias("c"))
    assert {r.n: r.c.name for r in covers.collect()} == {"a.epub": "img/one.png", "b.epub": "img/one.png", "c.epub": "", "d.epub": ""}


def test_declared_covers(tmp_path):
    book(tmp_path / "e.epub", {"META-INF/container.xml": '<c full-path="o/p.opf"/>', "o/p.opf": OPF, "o/img/one.png": PNG, "o/cover.png": PNG})
    assert content.cover_of((tmp_path / "e.epub").read_bytes(), ".epub") == ("o/img/one.png", len(PNG))
    assert content.cover_of((tmp_path / "e.epub").read_bytes(), ".zip") == ("o/cover.png", len(PNG))
    assert content.cover_of(b"broken", ".epub") == ("", 0)


def test_jpeg_sizes_behind_long_metadata():
    frame = b"\xff\xc0" + (17).to_bytes(2, "big") + b"\x08" + (480).to_bytes(2, "big") + (640).to_bytes(2, "big") + b"\x03" + b"\0" * 9
    segment = b"\xff\xe1" + (65_535).to_bytes(2, "big") + b"\xff\xc0" * 32_766 + b"\0"
    assert content.image_size(b"\xff\xd8" + segment * 40 + frame) == (640, 480)
    assert content.image_size(b"\xff\xd8" + b"\xff\xd9") is None


def test_stored_texts(spark):
    body = "첫 줄입니다  \n둘째 줄"
    df = spark.createDataFrame([(bytearray(body.encode("cp949")), bytearray(b"\xef\xbb\xbf" + body.replace("  \n", "\r\n").encode())), (bytearray(b"a"), bytearray(b"b")), (bytearray(b"a"), bytearray(b"a"))], "left binary, right binary")
    got = compare.stored(df).collect()
    assert [(r.same_text, r.storage_only) for r in got] == [(True, True), (False, False), (True, False)]
    assert (got[0].left_profile.encoding, got[0].right_profile.bom, got[0].right_profile.crlf, got[0].left_profile.trailing_spaces) == ("CP949", "UTF-8", 1, 2)
    assert [r[0] for r in df.select(compare.binary_verdict(F.col("left"), F.col("right"))).collect()] == ["different bytes", "different bytes", "same bytes"]


def test_one_sided_sentences(spark):
    left = spark.createDataFrame([(1, 0, "The old harbour was quiet in winter."), (1, 1, "Nothing like it.")], "pair int, no int, sentence string")
    right = spark.createDataFrame([(1, 0, "The old harbour was quiet in the winter."), (1, 1, "Zzz qqq.")], "pair int, no int, sentence string")
    got = compare.with_one_sided(compare.similar_sentences(left, right, "pair"), left, right, "pair").orderBy("row").collect()
    assert [(r.left_text != "", r.right_text != "") for r in got] == [(True, True), (True, False), (False, True)] and got[0].similarity > 90 and [tuple(x) for x in got[1].left] == [(0, 16)]

"""Archive members beside files: scans that nothing fails, catalogs, titles, text, components, and the report on archives."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.functions import registered, rename
from quarry.plans import archives, commands
from quarry.sources import items

BODY = "이 문장은 충분히 길게 쓰인 본문입니다. 두 번째 문장도 충분히 길게 쓰였습니다. "
OTHER = "전혀 다른 글이 여기에 들어 있습니다. 그리고 또 이어집니다. " * 3


def write(folder, name, members):
    with zipfile.ZipFile(folder / name, "w") as z:
        for m, data in members.items():
            z.writestr(m, data)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    (root / "sub").mkdir()
    (root / "겨울 항구.txt").write_text(BODY)
    (root / "sub" / "[가] 겨울 항구.txt").write_text(BODY)
    (root / "홀로.txt").write_text(OTHER)
    write(root, "상자.zip", {"겨울 항구.txt": BODY, "바다/여름 2권.txt": OTHER, "사진.jpg": b"\xff\xd8", "._x": "noise"})
    write(root, "상자 (2).zip", {"겨울 항구.txt": BODY, "바다/여름 2권.txt": OTHER, "사진.jpg": b"\xff\xd8"})
    write(root, "작은.zip", {"겨울 항구.txt": BODY})
    write(root, "많은.zip", {f"{k}.txt": str(k) for k in range(8)})
    write(root, "빈.zip", {})
    (root / "깨진.zip").write_bytes(b"no archive")
    os.symlink(root / "홀로.txt", root / "link.txt")
    os.symlink(root / "nowhere", root / "dangling")
    return root


@pytest.fixture(scope="module")
def rows(spark, folder):
    return items.scan(spark, str(folder), "content").cache()


def test_nothing_fails_a_scan(spark, rows, folder):
    kinds = {r.kind: r.n for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"file": 9, "zip item": 15, "broken": 1}
    assert [r.path.split("/")[-1] for r in items.skipped(rows).collect()] == ["깨진.zip"]
    assert {r.reason for r in items.skipped(rows, most=4).collect() if r.path.endswith("많은.zip")} == {"only 4 entries taken"}
    assert items.scan(spark, str(folder / "absent")).where("kind = 'skipped'").count() == 1
    assert items.scan(spark, str(folder), recursive="false").where("path LIKE '%/sub/%'").count() == 0


def test_items_and_filters(spark, rows, folder):
    found = items.items(rows)
    assert found.where("kind = 'zip item'").count() == 15 and found.where("inner LIKE '바다/%'").select("name").distinct().collect()[0].name == "여름 2권.txt"
    assert items.items(rows, most=4).where("path LIKE '%많은.zip' AND inner <> ''").count() == 4
    assert {r.name for r in items.catalog_items(rows, "여름").collect()} == {"여름 2권.txt"}
    assert {r.extension for r in items.title_items(rows).collect()} == {".txt", ".zip"}
    assert items.of_extensions(found, "jpg").count() == 2 and items.of_extensions(found, "jpg", containers=True).where("kind = 'file'").count() == 6
    assert items.of_extensions(found, "all").count() == found.count()
    assert items.at_least(found, 1).count() == 0
    assert found.where(items.any_text_matches(found.select("name", "kind"), "ZIP")).count() == 21
    top, counts = items.limited(found, 3, F.col("location"))
    assert top.count() == 3 and tuple(counts.first()) == (24, 3)
    one = items.one_entry(spark, f"{folder}/상자.zip :: 겨울 항구.txt").collect()
    assert len(one) == 1 and bytes(one[0].content).decode() == BODY
    assert bytes(items.one_entry(spark, f"{folder}/홀로.txt").collect()[0].content).decode() == OTHER
    assert items.paths_argument('["a", {"path": "b", "size": 1}]') == ["a", {"path": "b", "size": 1}] and items.paths_argument("[a, 'b']") == ["a", "'b'"] and items.paths_argument("") == []
    with pytest.raises(ValueError):
        items.paths_argument('{"a": 1}')


def test_commands_see_members(rows):
    found = items.items(rows)
    assert commands.catalog(found).count() == 24 and commands.catalog(found, query="여름").count() == 2
    got = commands.titles(found).where("title_key = '겨울항구'").collect()
    assert len(got) == 5 and [r.kind for r in got if r.keep] == ["file"] and [r.location.split("/")[-1] for r in got if r.keep] == ["겨울 항구.txt"]
    assert commands.titles(found, "sub/").where("title_key = '겨울항구'").count() == 5 and commands.titles(found, "nothing such").count() == 0
    prints = commands.text_duplicates(found)
    assert prints.count() == 5 + 3 and {r.location.split("/")[-1] for r in prints.where("keep").collect()} == {"[가] 겨울 항구.txt", "여름 2권.txt"}  # the first by location
    known = commands.text_prints(found)
    again = commands.text_duplicates(found.withColumn("content", F.lit(None).cast("binary")), cached=known)
    assert again.count() == 8
    assert commands.content_duplicates(found, 0).where("extension = '.txt'").count() == 8
    sizes = commands.size_duplicates(found, 0, found).where("name LIKE '상자%'").collect()
    assert len(sizes) == 2 and all(not r.health.broken and r.health.members in (3, 4) for r in sizes) or len(sizes) == 0


def test_comprehensive_keeps_members_first_in_mixed_groups(spark, rows):
    out = commands.comprehensive(items.items(rows)).collect()
    group = [r for r in out if "겨울 항구" in r.location]
    assert len({r.component for r in group}) == 1
    kept = [r for r in group if r.keep]
    assert len(kept) == 1 and kept[0].kind == "zip item" and kept[0].verdict == "keep"
    assert {r.verdict for r in group if not r.keep} == {"duplicate"} and all(r.auto_select == (r.kind == "file") for r in group if not r.keep)
    base = commands.comprehensive(items.items(rows)).withColumn("extension", F.lit(".txt"))
    choice = spark.createDataFrame([(group[0].component, next(r.location for r in group if r.kind == "file"))], "component long, location string")
    again = {r.location: r for r in commands.rechosen_verdicts(base, choice).collect()}
    assert [r.kind for r in again.values() if r.keep and r.component == group[0].component] == ["file"]
    stats = commands.comprehensive_stats(base).first()
    assert stats.rows == len(out) and stats.groups == len({r.component for r in out})


def test_verdicts(spark):
    shape = "location string, kind string, keep boolean, hash string, extension string, keep_hash string, keep_extension string, evidence string"
    df = spark.createDataFrame([("a", "file", True, "1", ".t", "1", ".t", "hash"), ("b", "zip item", False, "1", ".t", "1", ".t", "hash"), ("c", "file", False, "2", ".t", "1", ".t", "hash, title"), ("d", "file", False, None, ".t", "1", ".t", "title")], shape)
    got = {r.location: (r.confidence, r.verdict, r.auto_select, r.evidence) for r in commands.verdicts(df).collect()}
    assert got == {"a": ("certain", "keep", False, "hash"), "b": ("certain", "duplicate", False, "hash"), "c": ("review", "review", False, "hash, title, other hash than kept"), "d": ("review", "review", False, "title")}


def test_group_starts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None), (6, "a")], "n int, g string").repartition(3)
    assert {r.n: r.starts for r in commands.with_group_starts(df, "g", ["n"]).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True}


def test_enrichment_reads_only_what_says_nothing(spark, tmp_path):
    (tmp_path / "0259276.txt").write_text("http://x.y\n여름 정원의 기록\n이어지는 본문")
    (tmp_path / "[김작가] 푸른 등대 3화.txt").write_text("본문")
    found = items.items(items.scan(spark, str(tmp_path), "content"))
    got = {r.name: r for r in commands.enriched(commands.catalog(found), found).collect()}
    assert got["0259276.txt"].shown_title == "여름 정원의 기록" and got["0259276.txt"].title_from_content
    assert got["[김작가] 푸른 등대 3화.txt"].shown_author == "김작가" and not got["[김작가] 푸른 등대 3화.txt"].title_from_content
    assert not commands.enriched(commands.catalog(found)).where("title_from_content").count()


def test_rename_plan(spark):
    files = spark.createDataFrame([("/x/[김작가] 별빛 1권.txt", 1), ("/x/별빛 2권.txt", 1), ("/x/B_c.txt", 1), ("/x/b c.txt", 1), ("/x/d.txt", 1)], "path string, size long").withColumn("modified", F.current_timestamp())
    plan = {r.source: r for r in commands.rename_plan(files, rename.Options(), existing=spark.createDataFrame([("d.txt",)], "name string")).collect()}
    assert plan["별빛 2권.txt"].target == "[김작가] 별빛 2권.txt" and plan["별빛 2권.txt"].status == "ready"
    assert plan["[김작가] 별빛 1권.txt"].status == "unchanged" and plan["d.txt"].status == "unchanged"
    numbered = {r.source: r.target for r in commands.rename_plan(files, rename.Options(auto_author=False, start_number=1, padding=2, number_separator=" ")).collect()}
    assert numbered["[김작가] 별빛 1권.txt"].endswith(" 01.txt") and numbered["b c.txt"] == "b c 02.txt" and numbered["B_c.txt"] == "B c 03.txt"
    assert {r.status for r in commands.rename_plan(files, rename.Options(find="(", regex=True)).collect()} == {"regex error"}
    own = spark.createDataFrame([("/x/d.txt", "이저자")], "location string, creator string")
    assert {r.source: r.target for r in commands.rename_plan(files, rename.Options(), own).collect()}["d.txt"] == "[이저자] d.txt"


MEMBER = "archive string, inner string, extension string, sha256 string, size long, entry int"


def bag(spark, **held):
    rows = [(a, m, "." + m.rsplit(".", 1)[1], h, 1, k) for a, ms in held.items() for k, (m, h) in enumerate(ms.items())]
    return spark.createDataFrame(rows, MEMBER)


def test_archive_report(spark):
    full = {"x.txt": "1", "y.txt": "2", "z.txt": "3"}
    members = bag(spark, full=full, copy=full, part={"x.txt": "1"}, part2={"y.txt": "2", "x.txt": "1"}, old={"x.txt": "1", "바다 1권.txt": "9", "푸른 하늘.txt": "8"}, new={"x.txt": "1", "바다 1권.txt": "7", "푸른 하늘 이야기.txt": "6"}, alone={"q.txt": "99"}, loose={"r.txt": "77"})
    names = {"full": "가.zip", "copy": "나.zip", "part": "다.zip", "part2": "라.zip", "old": "모음 1.zip", "new": "[t] 모음.1.zip", "alone": "마.zip", "loose": "바.zip", "bad": "사.zip", "void": "아.zip"}
    found = spark.createDataFrame([(p, n, 2 if p == "full" else 1, int(p == "bad")) for p, n in names.items()], "path string, name string, modified int, errors int")
    external = spark.createDataFrame([(".txt", "77")], "extension string, sha256 string")
    report = {r.path: r for r in archives.archive_report(found, members, external).collect()}
    assert {p: r.status for p, r in report.items()} == {"full": "all-matched", "copy": "keep", "part": "subset", "part2": "subset", "old": "partial", "new": "partial", "alone": "unmatched", "loose": "partial", "bad": "broken", "void": "empty"}
    assert report["part"].target == "part2" and report["part2"].target == "copy" and report["full"].target == "copy" and report["copy"].target == "full"
    assert report["full"].auto_select and not report["copy"].auto_select and report["part"].auto_select
    assert report["old"].target == "new" and report["old"].changed == ["바다 1권.txt"] and [tuple(p) for p in report["old"].pairs] == [("바다 1권.txt", "바다 1권.txt"), ("푸른 하늘.txt", "푸른 하늘 이야기.txt")]
    assert report["loose"].externally_covered and not report["alone"].compared
    assert report["full"].comparison_group == report["part"].comparison_group != report["old"].comparison_group
    assert report["full"].duplicate_group == report["copy"].duplicate_group and report["part"].duplicate_group is None
    stats = archives.archive_stats(archives.archive_report(found, members, external)).first()
    assert (stats.archives, stats.compared, stats.matched, stats.selectable, stats.groups) == (10, 6, 3, 3, 2)


def test_what_holds_an_archive_is_its_superset(spark):
    members = bag(spark, big={"x.txt": "1", "y.txt": "2", "z.txt": "3"}, s1={"x.txt": "1"}, s2={"y.txt": "2"})
    found = spark.createDataFrame([(p, f"{p}.zip", 1, 0) for p in ("big", "s1", "s2")], "path string, name string, modified int, errors int")
    report = archives.archive_report(found, members).cache()
    assert {r.path: (r.status, r.target) for r in report.collect()} == {"big": ("superset", "s2"), "s1": ("subset", "big"), "s2": ("subset", "big")}
    assert report.orderBy(*archives.display_order(report)).first().path == "big" and archives.selectable_groups(report).count() == 3


def test_functions_from_sql(spark, folder):
    assert "archive_members" in registered.register(spark)
    got = spark.sql(f"SELECT member, size FROM archive_members('{folder}/작은.zip')").collect()
    assert [(r.member, r.size) for r in got] == [("겨울 항구.txt", len(BODY.encode()))]
    assert spark.sql(f"SELECT error FROM archive_members('{folder}/깨진.zip')").first().error.startswith("BadZipFile")
    assert spark.sql("SELECT name_fields('[가] 푸른 등대 3화.txt').episode AS e, says_nothing('0123') AS s").first().asDict() == {"e": 3, "s": True}

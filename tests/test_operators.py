"""Grouping, components, matching, manifests, incremental work and commands on small tables."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.functions import names
from quarry.operators import grouping, library, manifest, matching
from quarry.operators.components import connected_components
from quarry.plans import archives, commands
from quarry.sources import files
from quarry.sources.archive import ArchiveSource
from quarry.streaming import incremental


def plain_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2060)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain_components(edges)
    assert connected_components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).count() == 0


def test_same_content_is_within_same_size(spark):
    df = spark.createDataFrame([(1, 3, "abc"), (2, 3, "abc"), (3, 3, "xyz"), (4, 2, "ab"), (5, None, None)], "id int, n int, x string")
    assert sorted(r.id for r in grouping.same_content(df, "n", "x").collect()) == [1, 2]


def test_volume_split_and_survivor(spark):
    df = spark.createDataFrame([(1, "g", "v1"), (2, "g", "v2"), (3, "g", ""), (4, "h", "v1"), (5, "h", None)], "id int, grp string, sig string")
    got = {r.id: r.part for r in grouping.split_by_volume(df, "grp", "sig").collect()}
    assert got == {1: "v1", 2: "v2", 3: "", 4: "", 5: ""}
    assert sorted(r.id for r in grouping.survivor(df, ["grp"], [("id", "desc")]).where("keep").collect()) == [3, 5]


def test_bags_count_copies(spark):
    held = [("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("c", 2), ("c", 1), ("d", 3)]
    members = spark.createDataFrame([(a, ".x", str(i), 1) for a, i in held], "archive string, extension string, sha256 string, size int").repartition(3)
    found = archives.bags(members)
    bag = {r.archive: (r.bag, r.n) for r in found.collect()}
    assert bag["a"] == bag["c"] and bag["a"][1] == 3 and len(set(bag.values())) == 3
    inside = {(r.bag, r.holder, r.extra) for r in archives.contained_bags(members, found).collect()}
    assert inside == {(bag["b"][0], bag["a"][0], 1)}


def test_survivors_in_both_directions(spark):
    rows = [("g", "ab", 5, None), ("g", "a", 5, True), ("g", "abc", 1, False), ("g", None, 5, True), ("h", "ß", -(2**63), True), ("h", "z", 2**63 - 1, False)]
    df = spark.createDataFrame(rows, "grp string, s string, n long, b boolean").repartition(3)
    kept = lambda *order: sorted((r.grp, r.s) for r in grouping.survivor(df, ["grp"], list(order)).where("keep").collect())
    assert kept(("s", "desc")) == [("g", "abc"), ("h", "ß")] and kept("s") == [("g", "a"), ("h", "z")]
    assert kept(("n", "desc"), ("s", "desc")) == [("g", "ab"), ("h", "z")] and kept("n") == [("g", "abc"), ("h", "ß")]
    assert kept(("b", "desc"), "s") == [("g", "a"), ("h", "ß")] and kept(F.col("b"), "s") == [("g", "abc"), ("h", "z")]
    with pytest.raises(ValueError):
        kept(("s", "down"))


def test_manifest(spark):
    old = spark.createDataFrame([("x", "aa"), ("y", "bb")], "loc string, data string")
    new = spark.createDataFrame([("p", "bb"), ("q", "cc"), ("r", "bb")], "loc string, data string")
    got = {r.location: (r.status, r.matched) for r in manifest.check(new, "loc", "data", manifest.entries(old, "loc", "data")).collect()}
    assert got == {"p": ("have", "y"), "q": ("new", None), "r": ("have", "y")}


def test_breaker(spark):
    sequences = {"a": "DDD", "b": "DD.DD", "c": "DbDD", "d": "b" * 40, "e": "D." * 12}
    rows = [(g, i, {"D": "device", "b": "benign", ".": "ok"}[c]) for g, s in sequences.items() for i, c in enumerate(s)]
    df = spark.createDataFrame(rows, "g string, i int, o string")
    got = {r.g: r.tripped for r in incremental.breaker(df, ["g"], ["i"], "o", 3, 12).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False, "e": True}
    assert not any(r.tripped for r in incremental.breaker(df, ["g"], ["i"], "o", 0, 0).collect())


def test_greedy_pairs(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.85), (1, 2, 2, 0.5), (1, 3, 3, 0.1)], "g int, l int, r int, s double")
    assert sorted((r.l, r.r) for r in matching.greedy_pairs(df, "g", "l", "r", "s").collect()) == [(1, 1), (2, 2)]
    assert abs(df.select(matching.sequence_ratio(F.lit("abcd"), F.lit("bcde"))).first()[0] - 0.75) < 1e-9


def test_series_folding_and_similarity(spark):
    df = spark.createDataFrame([("별빛",), ("별빛 외전",), ("별빛 외전 둘",), ("바다",)], "k string")
    assert {r.k: r.root for r in library.fold_series(df, "k").collect()} == {"별빛": "별빛", "별빛 외전": "별빛", "별빛 외전 둘": "별빛", "바다": "바다"}
    got = spark.range(1).select(library.bigram_similarity(F.lit("night"), F.lit("nacht")), library.bigram_similarity(F.lit("ab"), F.lit("abc")), library.natural_key(F.lit("a10b")) > library.natural_key(F.lit("a9b"))).first()
    assert got[0] == 0.25 and got[1] == 0.98 and got[2]


def test_filters(spark):
    df = spark.createDataFrame([("/a/.git/x",), ("/a/b/c.txt",), ("/a/tmp/d.txt",), ("/z/q/e.txt",)], "p string")
    assert [r.p for r in df.where(files.outside(F.col("p"), "tmp; /z/q")).collect()] == ["/a/b/c.txt"]
    assert files.allowed_extensions("txt, .epub zip") == {".txt", ".epub", ".zip", ".cbz"} and files.allowed_extensions("*") is None


def test_archives_and_commands(spark, tmp_path):
    for name, members in {"a.zip": {"x.txt": "1" * 50, "y.txt": "2" * 60}, "b.zip": {"z.txt": "1" * 50, "y.txt": "2" * 60}, "c.zip": {"y.txt": "2" * 60}, "d.zip": {"w.txt": "3" * 40}}.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for m, text in members.items():
                z.writestr(m, text)
            z.writestr("__MACOSX/._x", "noise")
    (tmp_path / "bad.zip").write_bytes(b"not an archive")
    (tmp_path / "_hidden.txt").write_text("seen all the same")
    spark.dataSource.register(ArchiveSource)
    rows = spark.read.format("archive").option("level", "hash").load(str(tmp_path))
    assert rows.where("kind = 'zip item'").count() == 6 and rows.where("kind = 'broken'").count() == 1 and rows.where("path LIKE '%_hidden.txt'").count() == 1
    members = rows.where("kind = 'zip item'").select(F.regexp_extract("path", "([^/]+)$", 1).alias("archive"), F.col("member").alias("inner"), names.extension(F.col("member")).alias("extension"), "sha256", "size", "entry")
    found = members.select(F.col("archive").alias("path"), F.col("archive").alias("name"), F.lit(1).alias("modified"), F.lit(0).alias("errors")).distinct()
    got = {r.path: r.status for r in archives.archive_report(found, members).collect()}
    assert got == {"a.zip": "keep", "b.zip": "all-matched", "c.zip": "subset", "d.zip": "unmatched"}


def test_comprehensive(spark, tmp_path):
    body = "이 문장은 충분히 길게 쓰인 본문입니다. 두 번째 문장도 충분히 길게 쓰였습니다. "
    for name, text in {"[가] 겨울 항구.txt": body, "겨울 항구 (2).txt": body, "다른 이름.txt": body, "홀로 선 글.txt": "전혀 다른 글이 여기에 들어 있습니다. " * 3}.items():
        (tmp_path / name).write_text(text)
    found = files.scan(spark, str(tmp_path), content=True)
    assert commands.catalog(found.drop("content")).count() == 4
    assert commands.titles(found.drop("content")).count() == 2
    assert commands.text_duplicates(found).count() == 3
    got = commands.comprehensive(found).collect()
    assert len(got) == 3 and sum(r.keep for r in got) == 1 and {r.confidence for r in got} == {"certain"} and sum(r.auto_select for r in got) == 2


def test_streaming_scan_reads_each_file_once(spark, tmp_path):
    source, state, out = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "out")
    source.mkdir()
    (source / "a.txt").write_text("a")
    (source / "b.txt").write_text("b")

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    incremental.scan_new_files(spark, str(source), state, sink, 1).awaitTermination()
    (source / "c.txt").write_text("c")
    incremental.scan_new_files(spark, str(source), state, sink, 1).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_choices_moves_and_lists(spark):
    df = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "c", True), (2, "d", False)], "g int, p string, keep boolean")
    chosen = spark.createDataFrame([(1, "b"), (2, "zzz")], "g int, p string")
    assert {r.p: r.keep for r in grouping.rechosen(df, "g", "p", chosen).collect()} == {"a": False, "b": True, "c": True, "d": False}
    assert {r.p for r in grouping.without_moved(df, df.where("p = 'a'"), "p", "g").collect()} == {"c", "d"}
    wanted = spark.createDataFrame([("/r/x/a.txt", 1, "h1"), ("/r/y/a.txt", 2, "h2"), ("/o/b", 1, "h"), ("/r/gone", 1, "h"), ("/r/size", 1, "h"), ("/r/hash", 1, "h")], "location string, size long, sha256 string")
    now = spark.createDataFrame([("/r/x/a.txt", 1, "h1"), ("/r/y/a.txt", 2, "h2"), ("/o/b", 1, "h"), ("/r/size", 2, "h"), ("/r/hash", 1, "k")], "location string, size long, sha256 string")
    got = {r.location: (r.status, r.target) for r in manifest.verified_moves(wanted, now, "/r", "/q").collect()}
    assert got["/r/x/a.txt"] == ("ready", "/q/a.txt") and got["/r/y/a.txt"] == ("ready", "/q/a (1).txt")
    assert [got[k][0] for k in ("/o/b", "/r/gone", "/r/size", "/r/hash")] == ["outside root", "missing", "size changed", "content changed"]
    names_of = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    assert {r.key: r.status for r in library.against_library(names_of("abc", "xyz", "q"), "key", names_of("abcdef"), names_of("xy")).collect()} == {"abc": "owned", "xyz": "rejected", "q": "new"}


def test_ranks_cover_the_table(spark):
    df = spark.range(500).withColumn("k", (F.col("id") * 7919) % 500).repartition(5)
    got = {r.k: r["rank"] for r in grouping.ranked(df, ["k"]).collect()}
    assert got == {k: k + 1 for k in range(500)}

"""Works, series, dashboards and lists against plain Python; display rules by golden values."""

import difflib
import random

from pyspark.sql import functions as F

from quarry.functions import display, names
from quarry.operators import library
from quarry.sources import results

ITEM = "location string, name string, title string, author string, thumbnail string, extension string, size long, modified string, episodes long, volumes long, complete boolean, tags array<string>, source string, position long"


def item(k, title, author="", ext=".txt", size=10, modified="2024-01-01", episodes=0, volumes=0, complete=False, tags=(), thumb="", source=""):
    return (f"/x/{k}", f"{title}{ext}", title, author, thumb, ext, size, modified, episodes, volumes, complete, list(tags), source, k)


ITEMS = [
    item(0, "푸른 등대 1권", "", ".epub", volumes=1, tags=["b", "a"]), item(1, "푸른 등대 1권", "김작가", ".txt", volumes=1, size=20), item(2, "푸른 등대 2권", "이작가", ".epub", volumes=2, complete=True, modified="2024-03-01"),
    item(3, "푸른 등대 외전", "", ".zip", thumb="t.png"), item(4, "홀로", "공금", ".txt"), item(5, "홀로", "박작가", ".txt", episodes=7, source="published"), item(6, "", "x"), item(7, "1권", "y", volumes=1),
]


def test_works_and_series(spark):
    items = spark.createDataFrame(ITEMS, ITEM)
    works = {r.title: r for r in library.works(items).collect()}
    assert set(works) == {"푸른 등대 1권", "푸른 등대 2권", "푸른 등대 외전", "홀로", "1권"}
    one = works["푸른 등대 1권"]
    assert (one.author, one.files, one.extensions, one.tags, one.latest_volume, one.removable, one.volumes, one.duplicates, one.size) == ("김작가", 2, [".epub", ".txt"], ["a", "b"], 1, 1, 0, True, 30)
    assert works["홀로"].author == "공금" and works["홀로"].removable == 0 and works["홀로"].sources == ["published"]
    series = {r.title: r for r in library.series(library.works(items)).collect()}
    assert set(series) == {"푸른 등대", "홀로", "1권"}
    fold = series["푸른 등대"]
    assert (fold.files, fold.extensions, fold.author, fold.thumbnail, fold.complete, fold.latest_volume, fold.removable, fold.volumes, fold.modified) == (4, [".epub", ".txt", ".zip"], "김작가", "t.png", True, 2, 1, 3, "2024-03-01")
    assert fold.titles == ["푸른 등대 1권", "푸른 등대 2권", "푸른 등대 외전"] and fold.key == "푸른 등대"
    assert library.series(library.works(items.limit(0))).count() == 0
    panels = {(r.panel, r.name): r.n for r in library.dashboard(items, library.works(items)).collect()}
    assert panels["extension", ".txt"] == 5 and panels["author", "김작가"] == 2 and ("author", "공금") not in panels and panels["largest", "푸른 등대 1권"] == 2
    assert panels["todo", "duplicate"] == 1 and panels["todo", "mixed"] == 1 and panels["total", "works"] == 5 and panels["total", "files"] == 8
    assert library.latest_candidates(library.works(items)).count() == 1
    ordered = [r.title for r in library.series(library.works(items)).orderBy(*library.work_order("files")).collect()]
    assert ordered[0] == "푸른 등대" and [r.title for r in library.works(items).orderBy(*library.work_order("episode")).collect()][0] == "홀로"


def test_records(spark):
    own = spark.createDataFrame([("a", "A", "", "", False, False, ""), ("b", "B", "5", "무협, 완결", False, True, "")], results.RECORD)
    new = spark.createDataFrame([("a", "A2", "1", "", False, False, ""), ("c", "C", "", "", True, False, ""), ("d", "D", " ", "", False, False, "")], results.RECORD)
    assert {r.key: r.title for r in library.import_records(own, new).collect()} == {"a": "A", "b": "B", "c": "C"}
    works = spark.createDataFrame([("A", "a", False, [".x"]), ("B", "b", True, [".x", ".y"]), ("%u1234", "b", True, [".x"])], "title string, author string, duplicates boolean, extensions array<string>")
    joined = works.join(own.drop("title").withColumn("t", F.upper("key")), F.col("title") == F.col("t"), "left")
    assert [r.title for r in joined.where(library.list_filter("marked")).collect()] == ["B"] and joined.where(library.list_filter("duplicate")).count() == 2 and joined.where(library.list_filter("mixed")).count() == 1 and joined.where(library.list_filter("all")).count() == 3
    assert [r.title for r in joined.where(library.work_query("무협")).collect()] == ["B"]
    assert [r.title for r in library.recommendations(joined).collect()] == ["B"]


def test_records_and_results_as_files(spark, tmp_path):
    own = spark.createDataFrame([("a", "A", "", "", False, False, ""), ("b", "B", "5", "x", False, True, None)], results.RECORD)
    assert results.export_records(own, str(tmp_path / "r"), ["no"], ["yes"]) == 1
    head, rows = results.load_records(spark, str(tmp_path / "r"))
    assert head["rejects"] == ["no"] and [r.key for r in rows.collect()] == ["b"]
    found = spark.createDataFrame([(k, f"name {k}") for k in range(10)], "n int, name string")
    saved = results.save_result(found, str(tmp_path / "s"), "catalog", {"min": 1}, 4, [F.col("n")])
    assert saved["truncated"] and (saved["total"], saved["shown"]) == (10, 4)
    head, rows = results.load_result(spark, str(tmp_path / "s"), "NAME 3")
    assert head["command"] == "catalog" and head["truncated"] and head["total"] == 1 and rows.first().n == 3
    try:
        results.load_result(spark, str(tmp_path / "r"))
        raise AssertionError
    except ValueError:
        pass
    assert results.merged_list(["a", "b"], ["b", "c", "c", "d"], ["d"]) == ["a", "b", "c"]
    assert [r.value for r in results.as_json(spark.createDataFrame([(1, None)], "a int, b string")).collect()] == ['{"a":1,"b":null}']


def test_merged_libraries_and_thumbnails(spark):
    rows = [("p", 0, 0, "old", ""), ("p", 1, 0, "new", "t"), ("q", 0, 1, "one", ""), ("q", 0, 3, "two", "u")]
    df = spark.createDataFrame(rows, "location string, library_pos int, item_pos int, name string, thumbnail string")
    assert {r.location: r.name for r in library.merged_libraries(df).collect()} == {"p": "new", "q": "two"}
    got = library.with_thumbnails(df.where("name = 'two' OR name = 'new'"), spark.createDataFrame([("p", "z"), ("q", "")], "location string, thumbnail string"))
    assert {r.location: r.thumbnail for r in got.collect()} == {"p": "z", "q": "u"}


def test_lists_against_a_library(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(7)))
    longs, shorts = sorted({word() for _ in range(60)}), sorted({word() for _ in range(30)})
    a, b = spark.createDataFrame([(x,) for x in longs], "l string"), spark.createDataFrame([(x,) for x in shorts], "s string")
    want = {(x, y) for x in longs for y in shorts if x and y and y in x}
    assert {tuple(r) for r in library.substring_pairs(a, "l", b, "s").collect()} == want and want
    wanted = spark.createDataFrame([("별빛",), ("푸른등대",), ("없는책",)], "w string")
    owned, bad = spark.createDataFrame([("별빛정원",), ("",)], "key string"), spark.createDataFrame([("등대",), ("별빛",)], "key string")
    assert {r.w: r.status for r in library.against_library(wanted, "w", owned, bad).collect()} == {"별빛": "owned", "푸른등대": "rejected", "없는책": "new"}
    works = spark.createDataFrame([("Blue Harbor",), ("Quiet",)], "title string")
    assert [r.title for r in library.rejected(works, spark.createDataFrame([(" harbor ",), ("zz",)], "reject string")).collect()] == ["Blue Harbor"]


def plain_likeness(a, b):
    if not a or not b:
        return 0.0
    if a in b or b in a:
        return 0.72 if max(len(a), len(b)) / min(len(a), len(b)) > 2.4 else 0.98
    x, y = ({t[k : k + 2] for k in range(len(t) - 1)} or {t} for t in (a, b))
    return 2 * len(x & y) / (len(x) + len(y))


def test_tracking_finds_what_is_alike(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 14))) for _ in range(25)]
    titles = base + [t[:k] + rng.choice("abcdef") + t[k + 1 :] for t in base for k in (1, len(t) - 1)] + [t + "x" for t in base]
    works = spark.createDataFrame([(str(k), t, "", f"{t} .txt") for k, t in enumerate(titles)], "key string, title string, author string, haystack string")
    got = {(r.keyword, r.key): round(r.score, 9) for r in library.track_alike(works, spark.createDataFrame([(t,) for t in base], "keyword string")).collect()}
    want = {}
    for word in set(base):
        for k, t in enumerate(titles):
            score = 1.0 if word in f"{t} .txt" else plain_likeness(word, t)
            if score >= 0.82:
                want[word, str(k)] = round(score, 9)
    assert got == want and len(want) > 30


def test_display_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(display.listed_title(lit("a\\b/[x] 〔y〕 My_book.v2.txt"))) == "My book v2"
    assert one(display.work_title(lit("/a/[x](y) C++_book (2).txt"))) == "C book" and one(display.work_title(lit("%uAC00%uB098.txt"))) == "가나"
    tokens = {"외전 3.txt": "E3", "번외편.txt": "E1", "x 1~3권.txt": "M1-3", "x 12권 완결.txt": "M12", "x 7.txt": "M7", "x 7 완결 (2).txt": "M7", "아무것도.txt": None}
    assert {k: one(display.part_token(lit(k))) for k in tokens} == tokens
    roots = {"푸른 등대 1권 ABC": "푸른 등대", "등대-외전": "등대", "1권": "1권", "완전변태 完전": "완전변태 完전", "하늘 完": "하늘", "홀로": "홀로"}
    assert {k: one(display.series_root(lit(k))) for k in roots} == roots
    assert [one(display.likely_author(lit(x))) for x in ("김작가", "공금", "a,b", "123", "x" * 21, "")] == [True, False, False, False, False, False]
    assert one(display.cover_key(lit("[e북] 푸른 등대 3권 (완결) 외전!"))) == "푸른등대"
    assert one(display.cover_score(lit("푸른 등대"), lit("김"), lit("푸른 등대 이야기"), lit("김작가"))) == 1.0 and one(display.cover_score(lit("가"), lit(""), lit("가"), lit(""))) == 0.0
    assert one(display.short_list(F.array(*map(lit, "abcdefg")), 3)) == "a, b, c ... (+4)" and one(display.short_list(F.array().cast("array<string>"))) == "-"
    assert one(display.short_hash(lit("0123456789" * 3))) == "01234567...23456789" and one(display.signed_number(lit(12345), " b")) == "+12,345 b" and one(display.signed_number(lit(-5))) == "-5"
    assert one(display.zip_date(lit(None).cast("timestamp"))) == "-"
    words = one(display.changed_words(lit("the old 항구, here"), lit("the new 항구 here")))
    assert [w.token for w in words if w.changed] == ["old"] and "".join(w.token for w in words) == "the old 항구, here"
    ranges = F.from_json(lit('[{"start":5,"end":9},{"start":0,"end":2},{"start":2,"end":3},{"start":8,"end":99},{"start":4,"end":4}]'), "array<struct<start:int,end:int>>")
    assert [tuple(r) for r in one(display.merged_ranges(ranges, lit(12)))] == [(0, 3), (5, 12)]
    diff = one(display.diff_ranges(lit("abcd"), lit("abXd!")))
    assert [tuple(r) for r in diff.left] == [(2, 3)] and [tuple(r) for r in diff.right] == [(2, 3), (4, 5)] and diff.similarity == round(100 * difflib.SequenceMatcher(None, "abcd", "abXd!", autojunk=False).ratio(), 1)
    listed = spark.createDataFrame([(n,) for n in ("a10.txt", "a9.txt", "a1234567890123456.txt", "a1234567890123457.txt", "a009b.txt")], "n string")
    assert [r.n for r in listed.orderBy(names.natural_key(F.col("n"))).collect()] == ["a9.txt", "a009b.txt", "a10.txt", "a1234567890123456.txt", "a1234567890123457.txt"]
    shown = spark.createDataFrame([(n,) for n in ("b 외전 1.txt", "b 2권.txt", "b 10권.epub", "b 3권.epub", "b.txt")], "n string")
    order = display.catalog_order(F.lit("b"), names.extension(F.col("n")), F.col("n"))
    assert [r.n for r in shown.orderBy(*order).collect()] == ["b 3권.epub", "b 10권.epub", "b 2권.txt", "b 외전 1.txt", "b.txt"]


def test_text_profiles(spark):
    texts = ["a  \r\nb\t\nc\rd ", "x​y​﻿", "", "no ends", "\r\n\r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r for r in df.select("t", *library.line_profile(F.col("t")), library.stored_alike(F.col("t")).alias("s")).collect()}
    first = got[texts[0]]
    assert (first.crlf, first.lf, first.cr, first.trailing_spaces, first.invisible_count) == (1, 1, 1, 4, 0)
    assert got[texts[1]].invisible == ["U+200B: 2", "U+FEFF: 1"] and got["\r\n\r\n"].crlf == 2
    same = spark.createDataFrame([("a \r\nb​",), ("a\nb ",)], "t string").select(library.stored_alike(F.col("t")).alias("s"))
    assert same.distinct().count() == 1

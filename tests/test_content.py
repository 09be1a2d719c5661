"""Books, titles from content, archives, images, renames and comparisons."""

import io
import zipfile

from pyspark.sql import functions as F

from quarry.functions import content as c
from quarry.functions import rename as r
from quarry.plans import compare


def book(title="겨울 항구", creator="가작가", extra=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfile full-path="OPS/b.opf"/></container>')
        z.writestr("OPS/b.opf", f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{title}</dc:title><dc:creator>{creator}</dc:creator>{extra}</metadata></package>')
        z.writestr("OPS/2.xhtml", "<p>둘</p>")
        z.writestr("OPS/1.xhtml", "<p>하나</p>")
    return out.getvalue()


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "."), data)
    return out.getvalue()


def test_books(spark):
    rows = [(book(),), (b"plain bytes",), (None,), (book(extra="<dc:publisher>푸른 출판</dc:publisher><dc:identifier>isbn 9780000000000</dc:identifier>"),)]
    df = spark.createDataFrame(rows, "data binary")
    got = [tuple(x.m) for x in df.select(c.epub_metadata("data").alias("m")).collect()]
    assert got == [("겨울 항구", "가작가", "personal"), ("", "", ""), ("", "", ""), ("겨울 항구", "가작가", "published")]
    bodies = [x[0] for x in df.select(c.epub_body("data")).collect()]
    assert bodies[0].endswith("<p>하나</p>\n<p>둘</p>") and bodies[1:3] == ["", ""]


def test_recovered_titles():
    assert c.title_from("=====\n\n여름 정원 이야기\n본문".encode(), ".txt") == "여름 정원 이야기"
    assert c.title_from("http://a.b\n첫눈\n".encode(), ".txt") == "첫눈"
    assert c.title_from(packed(**{"흰 구름 1권__txt": "본문"}), ".zip") == "흰 구름 1권"
    assert c.title_from(packed(**{"ㅂㄷㄱ__epub": book("여름 바다")}), ".zip") == "여름 바다"
    assert c.title_from(book("278a02"), ".epub") == "" and c.title_from(b"broken", ".zip") == "" and c.title_from(b"x", ".hwp") == ""


def test_health_images_categories(spark):
    assert c.health(packed(a__txt="1"), ".zip", 2) == ("sampled", 1, False)
    assert c.health(b"no", ".zip") == ("broken", 0, True) and c.health(b"", ".txt") == ("plain", 0, False)
    png = b"\x89PNG\r\n\x1a\n" + bytes(8) + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (48).to_bytes(2, "big") + (64).to_bytes(2, "big") + b"\x03" + bytes(9)
    svg = b'<svg viewBox="0 0 30 20"></svg>'
    df = spark.createDataFrame([(png,), (jpeg,), (svg,), (b"GIF89a\x05\x00\x06\x00",), (b"",)], "data binary")
    assert [x[0] for x in df.select(c.image_dimensions("data")).collect()] == ["640x480", "64x48", "30x20", "5x6", ""]
    assert [c.category(n) for n in ("a.ttf", "x/toc.xhtml", "cover.xhtml", "b.css", "t.html", "q.bin", "none")] == ["font", "contents", "image", "style", "body", ".bin", "other"]


def test_renames(spark):
    o = r.Options
    assert r.new_name("김작가_별빛_소설_1권.txt", o()) == "[김작가] 별빛 소설 1권.txt"
    assert r.new_name("abcabc.txt", o(find="abc", replace="x")) == "xabc.txt"
    assert r.new_name("abcabc.txt", o(find="abc", replace="x", position="back")) == "abcx.txt"
    assert r.new_name("abcabc.txt", o(find="abc", replace="x", position="anywhere")) == "xx.txt"
    assert r.new_name("abc.txt", o(find="b", replace="x", position="exact")) == "abc.txt"
    assert r.new_name("a1b.txt", o(find=r"(\d)", replace=r"<\1>", regex=True, position="anywhere")) == "a<1>b.txt"
    assert r.new_name("name (2).txt", o(drop_copy=True, start_number=5, number_separator="-", case="upper"), 2) == "NAME-007.txt"
    assert r.new_name("it's here.txt", o(author="X", author_at="suffix", case="title")) == "It'S Here [X].txt"
    df = spark.createDataFrame([("a_b.txt", 0), ("1_2.txt", 1)], "name string, i int")
    assert [x[0] for x in df.select(r.renamed(F.col("name"), F.col("i"), o(start_number=1))).collect()] == ["a b001.txt", "1_2002.txt"]
    names = spark.createDataFrame([("3947_[톤냐] 피 위에 핀 꽃 34화 (완결).txt", 7), ("별빛 정원 [무협, 완결] [김작가].epub", 1), ("바다의 노래 - 이바다.txt", 2), (None, 3)], "name string, smart int").drop("smart")
    got = {x.name: x.smart for x in r.with_smart_fields(names).collect()}
    first = got["3947_[톤냐] 피 위에 핀 꽃 34화 (완결).txt"]
    assert first.writer == "톤냐" and first.episodes == 34 and first.complete
    assert got["별빛 정원 [무협, 완결] [김작가].epub"].writer == "김작가" and got["별빛 정원 [무협, 완결] [김작가].epub"].stem == "별빛 정원 [무협, 완결]"
    assert got["바다의 노래 - 이바다.txt"].writer == "이바다" and got["바다의 노래 - 이바다.txt"].stem == "바다의 노래"
    titles = spark.createDataFrame([("--", "x"), ("겨울 항구 안내서", "y"), ("", "z"), (None, "n"), ("!!a!!!!!", "w")], "book string, file string")
    assert [x[0] for x in titles.select(r.shown_title(F.col("file"), F.col("book"))).collect()] == ["x", "겨울 항구 안내서", "z", "n", "w"]
    bad = df.select(r.planned(F.col("name"), F.col("i"), F.lit(""), o(find="(", regex=True)).alias("p")).collect()
    assert all(x.p.target is None and x.p.error for x in bad)


def test_text_verdicts(spark):
    s = [f"This is sentence number {k} of the text." for k in range(40)]
    text = lambda ks: " ".join(s[k] for k in ks)
    rows = [("same", range(10), range(10)), ("more", range(20), range(10)), ("less", range(10), range(20)), ("part", range(10), range(4, 14)), ("none", range(10), range(20, 30))]
    df = spark.createDataFrame([(n, text(a), text(b)) for n, a, b in rows] + [("empty", "", "")], "name string, left string, right string")
    got = {x.name: x.verdict for x in compare.compare_texts(df).collect()}
    assert got == {"same": "same sentences", "more": "left contains right", "less": "right contains left", "part": "partly same", "none": "different", "empty": "no text"}


def test_similar_sentences(spark):
    left = spark.createDataFrame([(1, 0, "The old harbour was quiet in winter."), (1, 1, "Nobody came to the lighthouse.")], "pair int, no int, sentence string")
    right = spark.createDataFrame([(1, 0, "Nobody ever came to the lighthouse."), (1, 1, "The old harbour was quiet in the winter."), (1, 2, "Zzz qqq.")], "pair int, no int, sentence string")
    got = compare.similar_sentences(left, right, "pair").collect()
    assert {(x.left_no, x.right_no) for x in got} == {(0, 1), (1, 0)} and all(x.score > 0.8 for x in got)


def test_archive_comparison(spark):
    schema = "name string, size long, crc32 string, sha256 string"
    a = spark.createDataFrame([("x", 1, "a", "1"), ("y", 1, "b", "2"), ("z", 1, "c", "3"), ("w", 1, "d", "4")], schema)
    b = spark.createDataFrame([("x", 1, "a", "1"), ("y", 2, "e", "5"), ("zz", 1, "c", "3"), ("v", 1, "f", "6")], schema)
    members = compare.compare_archives(a, b)
    assert {r.name: r.status for r in members.collect()} == {"x": "same", "y": "changed", "z": "renamed", "zz": "renamed", "w": "left_only", "v": "right_only"}
    assert compare.archive_verdict(members).first().verdict == "name lists differ"

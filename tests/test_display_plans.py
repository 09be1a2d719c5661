"""Orders of appearance, selection, covers within a budget, and summaries of books."""

import hashlib
import zipfile

from quarry.plans import display
from quarry.sources import items


def test_orders_and_selection(spark):
    rows = [("b", 3, False, "certain", False), ("a", 1, False, "review", False), ("b", 2, True, "certain", None), ("a", 4, True, "certain", True), (None, 5, None, "review", False)]
    df = spark.createDataFrame(rows, "component string, pos int, keep boolean, confidence string, auto_select boolean").repartition(3)
    assert [(r.component, r.pos) for r in display.in_order_of_appearance(df.where("component IS NOT NULL"), "component", "pos").orderBy("place").collect()] == [("a", 4), ("a", 1), ("b", 2), ("b", 3)]
    assert sorted(r.pos for r in display.confident_only(df).collect()) == [2, 3, 4]
    assert sorted(r.pos for r in display.selectable_groups(df).collect()) == [1, 4]
    assert [(r.component, r.place) for r in display.distinct_in_order(df, "component", "pos").orderBy("place").collect()] == [("a", 1), ("b", 2), (None, 3)]
    assert display.in_order_of_appearance(df.limit(0), "component", "pos").count() == 0


def test_covers(spark):
    rows = [("1", "file", ".epub", "A long title"), ("2", "file", ".TXT", "A long title"), ("3", "zip item", ".epub", "A long title"), ("4", "file", ".zip", "--"), ("5", "file", ".cbz", "Another title"), ("6", "file", None, None)]
    df = spark.createDataFrame(rows, "location string, kind string, extension string, shown_title string")
    took = lambda most: sorted(r.location for r in display.with_cover_budget(df, ["location"], most).where("take_cover").collect())
    assert took(0) == ["1", "4", "5"] and took(2) == ["1", "4"] and display.with_cover_budget(df, ["location"], 2).count() == 6
    assert display.with_cover_budget(df.where("extension = '.none'"), ["location"], 2).count() == 0 and took(9) == ["1", "4", "5"]
    known = spark.createDataFrame([("1",)], "location string")
    search = lambda most: [r.location for r in display.cover_searches(df, known, ["location"], most).collect()]
    assert search(9) == ["2", "5"] and search(0) == ["2"]


def test_summary_of_a_book(spark, tmp_path):
    page, cover = "<html><body><p>Text of the page.</p></body></html>", b"\x89PNG\r\n\x1a\n" + bytes(8) + (3).to_bytes(4, "big") + (4).to_bytes(4, "big")
    with zipfile.ZipFile(tmp_path / "book.epub", "w") as z:
        z.writestr("a.xhtml", page)
        z.writestr("cover.png", cover)
    row = display.book_summary(items.scan(spark, str(tmp_path), "content")).collect()
    assert len(row) == 1 and row[0].members == 2 and row[0].text_length > 10 and row[0].cover.name == "cover.png"
    assert row[0].member_hashes == {"a.xhtml": hashlib.sha256(page.encode()).hexdigest(), "cover.png": hashlib.sha256(cover).hexdigest()}
    whole = hashlib.sha256((tmp_path / "book.epub").read_bytes()).hexdigest()
    assert row[0].sha256 == whole and row[0].short_hash == whole[:16] and row[0].size_text.endswith("B")

"""What lists and reports show of a result: their order, what may be chosen, and for which rows covers are looked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import content, names, rename
from quarry.operators import grouping
from quarry.operators.joins import join_totals
from quarry.plans.compare import archive_summary

# Files that hold a cover, and files for which a cover may be looked for by title.
WITH_COVER = (".epub", ".zip", ".cbz")
SEARCHED_COVER = (".epub", ".zip", ".cbz", ".txt", ".pdf", ".html", ".xhtml")


def confident_only(rows: DataFrame) -> DataFrame:
    """Rows of a comprehensive result that are certain."""
    return rows.where("confidence = 'certain'")


def selectable_groups(rows: DataFrame, group: str = "component", select: str = "auto_select") -> DataFrame:
    """Whole groups in which any row can be selected."""
    return grouping.whole_groups_matching(rows, [group], F.coalesce(F.col(select), F.lit(False)))


def in_order_of_appearance(rows: DataFrame, group: str, position: str, keep: str = "keep") -> DataFrame:
    """`rows` with `place`, their place from 1: groups by their first position, in each what is kept first, then by position.

    A group's first position is found with partial sums, and places come from ranges, so neither a group nor the table is one task's.
    """
    first = rows.groupBy(group).agg(F.min(position).alias("_first"), F.count("*").alias("_n"))
    placed = join_totals(rows, first, [group], rows.count(), "_n").withColumn("_rest", ~F.coalesce(F.col(keep), F.lit(False)))
    return grouping.ranked(placed, ["_first", group, "_rest", position], "place").drop("_first", "_rest")


def distinct_in_order(rows: DataFrame, value: str, position: str) -> DataFrame:
    """(value, place): each value once, numbered by where it appears first. Nulls are a value."""
    return grouping.ranked(rows.groupBy(value).agg(F.min(position).alias("_first")), ["_first", value], "place").drop("_first")


def holds_cover(kind: Column, extension: Column) -> Column:
    """Whether a cover can be taken out of the file; members of archives are not opened for it."""
    return (kind == "file") & F.lower(extension).isin(*WITH_COVER)


def cover_can_be_searched(kind: Column, extension: Column, title: Column) -> Column:
    """Whether a title says enough to look for a cover by it."""
    return (kind == "file") & F.lower(extension).isin(*SEARCHED_COVER) & (F.coalesce(title, F.lit("")) != "") & ~rename.hardly_a_title(title)


def with_cover_budget(rows: DataFrame, order: list[str], most: int = 0) -> DataFrame:
    """`rows` (kind, extension) with `take_cover`: whether the cover is to be taken, for the first `most` in the order that hold one; 0 is no limit."""
    able = holds_cover(F.col("kind"), F.col("extension"))
    if not most:
        return rows.withColumn("take_cover", F.coalesce(able, F.lit(False)))
    first = rows.where(able).select(*order).orderBy(*order).limit(most).agg(F.max(F.struct(*order)).alias("_last"))  # one row
    return rows.crossJoin(F.broadcast(first)).withColumn("take_cover", F.coalesce(able & (F.struct(*order) <= F.col("_last")), F.lit(False))).drop("_last")


def cover_searches(rows: DataFrame, known: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first `most` rows (at least one) whose covers can be searched and are not among the `known` (location)."""
    left = rows.where(cover_can_be_searched(F.col("kind"), F.col("extension"), F.col("shown_title"))).join(known.select("location").distinct(), "location", "left_anti")
    return left.orderBy(*order).limit(max(1, most))


def book_summary(rows: DataFrame) -> DataFrame:
    """`archive_summary` of books read with content, with the short hash, the text's length, the cover, and each member's hash."""
    found = archive_summary(rows)
    books = rows.where("kind = 'file'").select("path", content.epub_body("content").alias("body"), content.cover("content", names.extension(F.col("path"))).alias("cover"))
    each = rows.where("kind = 'zip item'").groupBy("path", "member").agg(F.min("sha256").alias("sha256"))
    hashes = each.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("member", "sha256")))).alias("member_hashes"))  # the members of one book
    out = found.join(books.select("path", F.length("body").cast("long").alias("text_length"), "cover"), "path").join(hashes, "path", "left")
    return out.withColumns({"short_hash": F.substring("sha256", 1, 16), "size_text": names.size_text(F.col("file_size"))})

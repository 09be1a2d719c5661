"""Comparisons of pairs: texts by their sentences and how they are stored, archives and books by their members, other files by their bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import content, display, names
from quarry.functions.text import char_grams, decoded_labelled, sentences
from quarry.operators.library import line_profile, stored_alike
from quarry.operators.matching import greedy_pairs, sequence_ratio
from quarry.session import materialize


def _percent(part, whole):
    return F.round(part * 100.0 / F.greatest(whole, F.lit(1)), 1)


def compare_texts(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """`pairs` with common sentences, overlap with the smaller side, coverage of both sides and a verdict."""
    both = pairs.withColumns({"_a": sentences(F.col(left)), "_b": sentences(F.col(right))})
    both = both.withColumns({"common": F.size(F.array_intersect("_a", "_b")), "_n": F.size("_a"), "_m": F.size("_b"), "_same": F.col("_a") == F.col("_b")}).drop("_a", "_b")
    out = both.withColumns({"overlap": _percent(F.col("common"), F.least("_n", "_m")), "left_coverage": _percent(F.col("common"), F.col("_n")), "right_coverage": _percent(F.col("common"), F.col("_m"))})
    verdict = (
        F.when((F.length(left) == 0) & (F.length(right) == 0), "no text")
        .when(F.col("_same"), "same sentences")
        .when((F.col("right_coverage") >= 99.5) & (F.col("left_coverage") < 95), "left contains right")
        .when((F.col("left_coverage") >= 99.5) & (F.col("right_coverage") < 95), "right contains left")
        .when(F.col("overlap") >= 90, "mostly same")
        .when(F.col("overlap") >= 50, "partly same")
        .otherwise("different")
    )
    return out.withColumn("verdict", verdict).drop("_n", "_m", "_same")


def similar_sentences(left: DataFrame, right: DataFrame, pair: str, top: int = 8, overlap: float = 0.12, ratio: float = 0.28, most: int = 24) -> DataFrame:
    """(pair, left_no, right_no, left_text, right_text, score): the best one-to-one pairs of sentences of each pair.

    Both sides are (pair, no, sentence). Candidates share 4-grams; only the `top` for each left sentence are aligned.
    """
    a = left.select(pair, F.col("no").alias("left_no"), F.col("sentence").alias("left_text"), char_grams(F.col("sentence")).alias("g")).withColumn("na", F.size("g"))
    b = right.select(pair, F.col("no").alias("right_no"), F.col("sentence").alias("right_text"), char_grams(F.col("sentence")).alias("g")).withColumn("nb", F.size("g"))
    met = a.select(pair, "left_no", "na", F.explode("g").alias("gram")).join(b.select(pair, "right_no", "nb", F.explode("g").alias("gram")), [pair, "gram"])
    counts = met.groupBy(pair, "left_no", "right_no").agg(F.count("*").alias("n"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    rank = F.row_number().over(W.partitionBy(pair, "left_no").orderBy(F.desc("n"), "right_no"))
    near = counts.withColumn("_r", rank).where((F.col("_r") <= top) & (F.col("n") >= overlap * F.least("na", "nb"))).select(pair, "left_no", "right_no")
    scored = near.join(a.select(pair, "left_no", "left_text"), [pair, "left_no"]).join(b.select(pair, "right_no", "right_text"), [pair, "right_no"])
    return greedy_pairs(scored.withColumn("score", sequence_ratio("left_text", "right_text")), pair, "left_no", "right_no", "score", ratio, most)


def compare_archives(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, status) of members (name, size, crc32, sha256): same, changed, renamed, left only or right only."""
    x = left.select("name", F.struct("size", "crc32").alias("_x"), F.col("sha256").alias("_xs"))
    y = right.select("name", F.struct("size", "crc32").alias("_y"), F.col("sha256").alias("_ys"))
    both = x.join(y, "name", "full_outer")
    moved_l = both.where("_y IS NULL").select(F.col("name").alias("l"), F.col("_xs").alias("sha256"))
    moved_r = both.where("_x IS NULL").select(F.col("name").alias("r"), F.col("_ys").alias("sha256"))
    moved = moved_l.join(moved_r, "sha256").where("sha256 <> ''")
    renamed = moved.select(F.col("l").alias("name")).unionByName(moved.select(F.col("r").alias("name"))).distinct().withColumn("_moved", F.lit(True))
    status = F.when(F.col("_moved"), "renamed").when(F.col("_y").isNull(), "left_only").when(F.col("_x").isNull(), "right_only").when(F.col("_x") == F.col("_y"), "same").otherwise("changed")
    return both.join(renamed, "name", "left").select("name", status.alias("status"))


def archive_verdict(members: DataFrame) -> DataFrame:
    """One row: what the statuses of two archives' members amount to."""
    n = lambda s: F.count_if(F.col("status") == s)
    lists = n("left_only") + n("right_only")
    return members.agg(F.when(lists + n("renamed") > 0, "name lists differ").when(n("changed") > 0, "same names, other content").otherwise("same members").alias("verdict"), n("same").alias("same"), n("changed").alias("changed"), n("renamed").alias("renamed"), lists.alias("one_sided"))


def with_one_sided(pairs: DataFrame, left: DataFrame, right: DataFrame, pair: str, most: int = 24) -> DataFrame:
    """`similar_sentences` with the ranges that differ and, up to `most` rows of each pair, sentences of one side alone: a report."""
    diff = pairs.withColumn("d", display.diff_ranges("left_text", "right_text"))
    both = diff.select(pair, F.lit(0).alias("side"), "left_no", "right_no", "left_text", "right_text", "d.left", "d.right", "d.similarity")
    whole = lambda c: F.array(F.struct(F.lit(0).alias("start"), F.length(c).alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    nothing = F.lit("").alias
    only_left = left.join(pairs.select(pair, F.col("left_no").alias("no")), [pair, "no"], "left_anti").select(pair, F.lit(1).alias("side"), F.col("no").alias("left_no"), F.lit(None).cast("int").alias("right_no"), F.col("sentence").alias("left_text"), nothing("right_text"), whole("sentence").alias("left"), none.alias("right"), F.lit(0.0).alias("similarity"))
    only_right = right.join(pairs.select(pair, F.col("right_no").alias("no")), [pair, "no"], "left_anti").select(pair, F.lit(2).alias("side"), F.lit(None).cast("int").alias("left_no"), F.col("no").alias("right_no"), nothing("left_text"), F.col("sentence").alias("right_text"), none.alias("left"), whole("sentence").alias("right"), F.lit(0.0).alias("similarity"))
    every = both.unionByName(only_left).unionByName(only_right)
    rank = F.row_number().over(W.partitionBy(pair).orderBy("side", F.desc("similarity"), F.coalesce("left_no", "right_no")))
    return every.withColumn("row", rank).where(F.col("row") <= most)


def stored(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """`pairs` of bytes with the profile of how each text is stored, and whether the two differ in that alone."""
    out = pairs
    for side, c in (("_a", left), ("_b", right)):
        out = out.withColumn(side, decoded_labelled(c)).withColumn(f"{side}_p", F.struct(F.octet_length(c).alias("bytes"), F.col(f"{side}.encoding").alias("encoding"), F.col(f"{side}.bom").alias("bom"), *line_profile(F.col(f"{side}.text")), F.sha2(c, 256).alias("sha256"), stored_alike(F.col(f"{side}.text")).alias("stored_sha256")))
    same = F.col("_a_p.stored_sha256") == F.col("_b_p.stored_sha256")
    out = out.withColumns({"left_profile": F.col("_a_p"), "right_profile": F.col("_b_p"), "same_text": same, "storage_only": same & (F.col("_a_p.sha256") != F.col("_b_p.sha256"))})
    return out.drop("_a", "_b", "_a_p", "_b_p")


def binary_verdict(left: Column, right: Column) -> Column:
    """For files without readable text: the same bytes or not."""
    return F.when(F.sha2(left, 256) == F.sha2(right, 256), "same bytes").otherwise("different bytes")


def archive_summary(rows: DataFrame) -> DataFrame:
    """One row for each archive of `archive` rows: members, sizes, extra bytes, latest date, extensions and categories with numbers."""
    members = rows.where("kind = 'zip item'").withColumn("extension", F.coalesce(F.nullif(names.extension(F.col("member")), F.lit("")), F.lit("(none)"))).withColumn("category", content.member_category("member"))
    totals = members.groupBy("path").agg(
        F.count("*").alias("members"), F.sum("size").cast("long").alias("total_size"), F.sum("compressed").cast("long").alias("compressed_size"), F.sum("extra_size").cast("long").alias("extra_size"), F.sum("comment_size").cast("long").alias("comment_size"),
        F.max("modified").alias("latest"), F.array_sort(F.collect_list("member")).alias("names"),
    )

    def counted(column: str, name: str) -> DataFrame:
        n = members.groupBy("path", column).agg(F.count("*").alias("n"))
        return n.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))

    own = rows.where("kind = 'file'").select("path", F.col("size").alias("file_size"), "sha256")
    out = own.join(totals, "path").join(counted("extension", "extensions"), "path").join(counted("category", "categories"), "path")
    broken = rows.where("error IS NOT NULL").groupBy("path").agg(F.lit(True).alias("broken"))
    return out.join(broken, "path", "left").withColumns({"broken": F.coalesce("broken", F.lit(False)), "overhead": F.col("file_size") - F.col("compressed_size")})


def _sides(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """Members of both archives of each pair (pair, left, right) by name, as structs x and y."""
    members = rows.where("kind = 'zip item'").select(F.col("path").alias("_p"), F.col("member").alias("name"), F.struct(*columns).alias("m"))
    x = pairs.select("pair", F.col("left").alias("_p")).join(members, "_p").select("pair", "name", F.col("m").alias("x"))
    y = pairs.select("pair", F.col("right").alias("_p")).join(members, "_p").select("pair", "name", F.col("m").alias("y"))
    return x.join(y, ["pair", "name"], "full_outer")


def compare_zip_members(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(pair, name, status, method_changed): same, changed (by size or CRC32), left only or right only; nothing is decompressed."""
    both = _sides(pairs, rows, "size", "crc32", "method")
    differs = (F.col("x.size") != F.col("y.size")) | (F.col("x.crc32") != F.col("y.crc32"))
    status = F.when(F.col("y").isNull(), "left_only").when(F.col("x").isNull(), "right_only").when(differs, "changed").otherwise("same")
    return both.select("pair", "name", status.alias("status"), F.coalesce(F.col("x.method") != F.col("y.method"), F.lit(False)).alias("method_changed"))


def compare_books(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(pair, name, status, same_size, recompressed, metadata_changed) of hashed members.

    Status: same or changed by SHA-256, left only or right only. Members of equal content may be packed otherwise or carry
    other dates, extra fields, comments or flags.
    """
    both = _sides(pairs, rows, "size", "compressed", "method", "sha256", "modified", "extra_size", "comment_size", "flags")
    unlike = lambda *cs: F.coalesce(F.exists(F.array(*(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in cs)), lambda t: t), F.lit(False))
    status = F.when(F.col("y").isNull(), "left_only").when(F.col("x").isNull(), "right_only").when(unlike("sha256"), "changed").otherwise("same")
    out = both.withColumn("status", status)
    same = F.col("status") == "same"
    return out.select("pair", "name", "status", ((F.col("status") == "changed") & ~unlike("size")).alias("same_size"), (same & unlike("compressed", "method")).alias("recompressed"), (same & unlike("modified", "extra_size", "comment_size", "flags")).alias("metadata_changed"))


def renamed_members(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(pair, sha256, left_names, right_names): content that both books hold under different names, each once."""
    both = _sides(pairs, rows, "sha256")
    gather = lambda c: F.array_sort(F.collect_set(F.when(F.col(c).isNotNull(), F.col("name"))))
    long = both.select("pair", F.col("x.sha256").alias("sha256"), "name", F.lit(True).alias("l"), F.lit(None).cast("boolean").alias("r")).unionByName(both.select("pair", F.col("y.sha256").alias("sha256"), "name", F.lit(None).cast("boolean").alias("l"), F.lit(True).alias("r")))
    found = long.where("sha256 IS NOT NULL").groupBy("pair", "sha256").agg(gather("l").alias("left_names"), gather("r").alias("right_names"))
    moved = (F.size(F.array_except("left_names", "right_names")) > 0) | (F.size(F.array_except("right_names", "left_names")) > 0)
    return found.where((F.size("left_names") > 0) & (F.size("right_names") > 0) & moved)


def book_verdict(members: DataFrame) -> DataFrame:
    """(pair, verdict and counts) over `compare_books`: packaging only, extra members, or changed members."""
    n = lambda s: F.count_if(F.col("status") == s)
    sided = n("left_only") + n("right_only")
    verdict = F.when(n("changed") > 0, "changed members").when(sided > 0, "extra members").otherwise("packaging only")
    return members.groupBy("pair").agg(verdict.alias("verdict"), n("same").alias("same"), n("changed").alias("changed"), n("left_only").alias("left_only"), n("right_only").alias("right_only"), F.count_if("recompressed").alias("recompressed"), F.count_if("metadata_changed").alias("metadata_changed"), F.count_if("same_size").alias("same_size_changed"))


def newer_side(pairs: DataFrame, summaries: DataFrame, left_text: str = "left_text", right_text: str = "right_text") -> DataFrame:
    """`pairs` with the side to recommend: that of the latest inner date, else that of more text (numbers of characters), else none."""
    a, b = (summaries.select(F.col("path").alias(side), F.col("latest").alias(f"_{side}")) for side in ("left", "right"))
    out = pairs.join(a, "left", "left").join(b, "right", "left")
    x, y = F.col("_left"), F.col("_right")
    text = F.when(F.col(left_text) > F.col(right_text), "left").when(F.col(right_text) > F.col(left_text), "right").otherwise("none")
    return out.withColumn("recommended", F.when(x > y, "left").when(y > x, "right").otherwise(text)).drop("_left", "_right")


def book_images(rows: DataFrame) -> DataFrame:
    """(path, member, name, size, compressed, crc32, sha256, dimensions) of the images in archives read with content."""
    images = rows.where("kind = 'zip item'").withColumn("extension", names.extension(F.col("member"))).where(F.col("extension").isin(*content.IMAGES))
    return images.select("path", "member", "entry", F.regexp_replace("member", r"^.*/", "").alias("name"), "size", "compressed", "crc32", "sha256", content.image_dimensions("content").alias("dimensions"))


def aligned_images(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """(pair, left, right, basis, status): images of two books one to one: by path, then by content, then by name.

    Each of three passes numbers the rows of equal keys on both sides and joins equal numbers, so no two rows get one
    partner; what is left goes on. Members of a book are few keys of their own; nothing is compared across keys.
    """
    side = lambda s: pairs.select("pair", F.col(s).alias("path")).join(images, "path").select("pair", F.struct("member", "entry", "name", "size", "sha256", "dimensions").alias(s))
    left, right = materialize(side("left"), "left_images"), materialize(side("right"), "right_images")
    done = []
    keys = (("path", lambda s: F.lower(f"{s}.member")), ("content", lambda s: F.nullif(f"{s}.sha256", F.lit(""))), ("name", lambda s: F.lower(f"{s}.name")))
    for basis, key in keys:

        def numbered(df: DataFrame, s: str, key=key) -> DataFrame:
            place = F.row_number().over(W.partitionBy("pair", "_k").orderBy(f"{s}.entry"))
            return df.withColumn("_k", key(s)).where("_k IS NOT NULL").withColumn("_n", place)

        met = materialize(numbered(left, "left").join(numbered(right, "right"), ["pair", "_k", "_n"]).select("pair", "left", "right", F.lit(basis).alias("basis")), f"by_{basis}")
        done.append(met)
        left = left.join(met.select("pair", F.col("left.entry").alias("_e")), (left["pair"] == met["pair"]) & (F.col("left.entry") == F.col("_e")), "left_anti")
        right = right.join(met.select("pair", F.col("right.entry").alias("_e")), (right["pair"] == met["pair"]) & (F.col("right.entry") == F.col("_e")), "left_anti")
    out = done[0].unionByName(done[1]).unionByName(done[2])
    status = F.when(F.col("left.sha256") == F.col("right.sha256"), "same").when(F.col("left.size") == F.col("right.size"), "same size, other content").otherwise("other content")
    shape = "struct<member:string,entry:int,name:string,size:bigint,sha256:string,dimensions:string>"
    empty = F.lit(None).cast(shape)
    return (
        out.withColumn("status", status)
        .unionByName(left.select("pair", "left", empty.alias("right"), F.lit("").alias("basis"), F.lit("left_only").alias("status")))
        .unionByName(right.select("pair", empty.alias("left"), "right", F.lit("").alias("basis"), F.lit("right_only").alias("status")))
    )


def archive_pair_verdict(members: DataFrame, summaries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, verdict) over `compare_zip_members`: broken, name lists differ, other content, other compression, same make-up or other total size."""
    n = members.groupBy("pair").agg(F.count_if(F.col("status").isin("left_only", "right_only")).alias("sided"), F.count_if(F.col("status") == "changed").alias("changed"), F.count_if("method_changed").alias("methods"))
    s = lambda side: summaries.select(F.col("path").alias(side), F.struct("broken", "compressed_size", "total_size").alias(f"_{side}"))
    out = pairs.join(n, "pair", "left").join(s("left"), "left", "left").join(s("right"), "right", "left")
    broken = F.col("_left").isNull() | F.col("_right").isNull() | F.col("_left.broken") | F.col("_right.broken")
    verdict = (
        F.when(broken, "broken").when(F.col("sided") > 0, "name lists differ").when(F.col("changed") > 0, "same names, other content")
        .when((F.col("_left.compressed_size") != F.col("_right.compressed_size")) | (F.col("methods") > 0), "other compression").when(F.col("_left.total_size") == F.col("_right.total_size"), "same members").otherwise("other total size")
    )
    return out.select("pair", verdict.alias("verdict"))

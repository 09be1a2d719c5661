"""Views of a library: works, series, dashboards, reports, tracking, lists against it, rename plans and text profiles."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import display, names
from quarry.operators import grouping
from quarry.session import materialize

NONE = "array<string>"
BLOCK_CHARS, SHARE_CHARS, LEAST_SHARE = 1 << 20, 16 << 20, 1 << 18  # characters of the keys of one automaton, and of the texts that one task runs through it


def rename_status(plan: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """`plan` (source, target) with a status: regex error (no target), unchanged, target duplicated, target exists or ready.

    Counts of targets are made first and joined, so that a target that very many rows want is no single task's window.
    """
    wanted = plan.where("target IS NOT NULL").groupBy("target").agg(F.count("*").alias("_n"))
    out = plan.join(wanted, "target", "left")
    taken = F.lit(False)
    if existing is not None:
        out = out.join(existing.select(F.col("name").alias("target"), F.lit(True).alias("_taken")).distinct(), "target", "left")
        taken = F.coalesce("_taken", F.lit(False))
    status = F.when(F.col("target").isNull(), "regex error").when(F.col("target") == F.col("source"), "unchanged").when(F.col("_n") > 1, "target duplicated").when(taken, "target exists").otherwise("ready")
    return out.withColumn("status", status).drop("_n", "_taken")


def duplicates_or_series(files: DataFrame, work: str, volume: str) -> DataFrame:
    """(work, removable, series): surplus files of one volume, and the number of volumes where there are several."""
    volumes = files.groupBy(work, volume).agg(F.count("*").alias("n"))
    many = F.count_if(F.col(volume) != 0)
    return volumes.groupBy(work).agg(F.sum(F.col("n") - 1).alias("removable"), F.when(many > 1, many).otherwise(F.lit(0).cast("long")).alias("series"))


def top_tags(df: DataFrame, column: str, k: int) -> DataFrame:
    tags = df.select(F.explode(F.split(F.lower(column), r"[,\s]+")).alias("tag")).where("tag <> ''")
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def folder_report(df: DataFrame, parent: str, item: str, folders: int = 80, items: int = 120) -> DataFrame:
    """The largest folders with their first items. A report: both limits are the feature."""
    largest = df.groupBy(parent).agg(F.count("*").alias("n")).orderBy(F.desc("n"), parent).limit(folders)
    rank = F.row_number().over(W.partitionBy(parent).orderBy(item))
    return df.join(F.broadcast(largest), parent).withColumn("_r", rank).where(F.col("_r") <= items).select(parent, "n", item)


# --- works and series ------------------------------------------------------------------------------------------------


def works(items: DataFrame) -> DataFrame:
    """One row for each work over (location, name, title, author, thumbnail, extension, size, modified, episodes, volumes, complete, tags, source, position).

    Works go by the key of their title; files without one count for none. Author and thumbnail are the first by position
    that are not empty. Files of one volume (or episode) are duplicates of each other, different ones make a series.
    """
    number = F.when(F.coalesce("volumes", F.lit(0)) != 0, F.col("volumes")).otherwise(F.coalesce("episodes", F.lit(0)))
    keyed = items.withColumns({"key": display.work_key(F.col("title")), "number": number.cast("long")}).where("key <> ''")
    first = lambda c: F.coalesce(F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col("position"))), F.lit("")).alias(c)
    gathered = keyed.groupBy("key").agg(
        F.min_by("title", "position").alias("title"), first("author"), first("thumbnail"), F.count("*").alias("files"), F.array_sort(F.collect_set(F.coalesce(F.nullif(F.lower("extension"), F.lit("")), F.lit("-")))).alias("extensions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"), F.array_sort(F.collect_set(F.nullif("source", F.lit("")))).alias("sources"), F.bool_or(F.coalesce("complete", F.lit(False))).alias("complete"),
        F.max(F.coalesce("episodes", F.lit(0))).cast("long").alias("latest_episode"), F.max(F.coalesce("volumes", F.lit(0))).cast("long").alias("latest_volume"), F.sum("size").cast("long").alias("size"), F.max("modified").alias("modified"),
    )
    counts = duplicates_or_series(keyed, "key", "number").withColumnRenamed("series", "volumes")
    return gathered.join(counts, "key").withColumn("duplicates", F.col("removable") > 0)


def fold_series(found: DataFrame, key: str) -> DataFrame:
    """(key, root): the shortest other key that begins the key up to a space, or the key itself.

    Beginnings are spelled out and joined by equality, not compared pair by pair.
    """
    keys = found.select(key).distinct()
    parts = keys.select(key, F.split(key, " ").alias("p"))
    begins = parts.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", 1, n), " "))).alias("root"))
    known = begins.join(keys.select(F.col(key).alias("root")), "root", "left_semi")
    return known.groupBy(key).agg(F.min_by("root", F.length("root")).alias("root"))


def series(found: DataFrame) -> DataFrame:
    """`works` with those of one series as one: titles cut at their first mark of a part, and folded into the shortest that begins them."""
    cut = materialize(found.withColumn("base", display.series_root(F.col("title"))), "roots")
    rooted = cut.join(fold_series(cut.select("base"), "base"), "base")
    anchor = F.struct((F.col("title") != F.col("root")).alias("other"), F.length("base").alias("n"), F.col("title"))
    first = lambda c: F.coalesce(F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.struct(F.length("base"), "title"))), F.lit("")).alias(c)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    several = F.count("*") > 1
    folded = rooted.groupBy("root").agg(
        F.when(several, F.col("root")).otherwise(F.min("title")).alias("title"), F.min_by("key", anchor).alias("key"), first("author"), first("thumbnail"), F.sum("files").alias("files"), union("extensions"), union("tags"), union("sources"),
        F.bool_or("complete").alias("complete"), F.max("latest_episode").alias("latest_episode"), F.max("latest_volume").alias("latest_volume"), F.sum("size").alias("size"), F.max("modified").alias("modified"), F.sum("removable").alias("removable"),
        F.when(several, F.sum(F.greatest("volumes", F.lit(1)))).otherwise(F.min("volumes")).cast("long").alias("volumes"), F.bool_or("duplicates").alias("duplicates"), F.array_sort(F.collect_list("title")).alias("titles"),
    )
    return folded.withColumn("key", F.when(F.size("titles") > 1, display.work_key(F.col("root"))).otherwise(F.col("key"))).drop("root")


def merged_libraries(items: DataFrame, library: str = "library_pos", place: str = "item_pos", key: str = "location") -> DataFrame:
    """One row for each location: the last by the library's place in the list, then by its own."""
    last = items.groupBy(key).agg(F.max(F.struct(library, place)).alias("_last"))
    return items.join(last, key).where((F.col(library) == F.col("_last")[library]) & (F.col(place) == F.col("_last")[place])).drop("_last")


def with_thumbnails(items: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """`items` with new thumbnails (location, thumbnail) in place of theirs."""
    fresh = thumbnails.where("thumbnail <> ''").groupBy("location").agg(F.max("thumbnail").alias("_t"))
    return items.join(fresh, "location", "left").withColumn("thumbnail", F.coalesce("_t", "thumbnail")).drop("_t")


def has_record(prefix: str = "") -> Column:
    """Whether a user entered anything about a work: rating, tags, read, favorite, memo."""
    said = F.lit(False)
    for c in ("read", "favorite"):
        said = said | F.coalesce(F.col(f"{prefix}{c}"), F.lit(False))
    for c in ("rating", "user_tags", "memo"):
        said = said | (F.trim(F.coalesce(F.col(f"{prefix}{c}").cast("string"), F.lit(""))) != "")
    return said


def import_records(own: DataFrame, incoming: DataFrame, key: str = "key") -> DataFrame:
    """Own records, and the incoming ones that say something about works without an own record. Nothing is overwritten."""
    return own.unionByName(incoming.where(has_record()).dropDuplicates([key]).join(own.select(key), key, "left_anti"))


def list_filter(which: str) -> Column:
    """Works that a list shows: all, duplicate, mixed (several extensions) or marked (with a record)."""
    return {"duplicate": F.col("duplicates"), "mixed": F.size("extensions") > 1, "marked": has_record()}.get(which, F.lit(True))


def work_query(query: str) -> Column:
    """Works of which title, author, extensions or tags hold the query."""
    q = query.strip().lower()
    inside = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
    return F.lit(not q) | inside("title") | inside("author") | F.array_join("extensions", " ").contains(q) | inside("user_tags")


def work_order(by: str) -> list[Column]:
    """Orders of a list of works: title, files, modified, episode (else volume) or size, ties by title."""
    latest = F.when(F.col("latest_episode") != 0, F.col("latest_episode")).otherwise(F.col("latest_volume"))
    lead = {"files": [F.desc("files")], "modified": [F.desc_nulls_last("modified")], "episode": [latest.desc()], "size": [F.desc("size")]}.get(by, [])
    return [*lead, F.col("title")]


def dashboard(items: DataFrame, found: DataFrame, most: int = 6) -> DataFrame:
    """(panel, name, n): totals, the most frequent extensions and authors, the largest works with duplicates, what is to be done. A report of top `most`."""

    def panel(name: str, df: DataFrame, k: int = most) -> DataFrame:
        return df.orderBy(F.desc("n"), "name").limit(k).select(F.lit(name).alias("panel"), "name", F.col("n").cast("long").alias("n"))

    ext = F.coalesce(F.nullif(F.lower("extension"), F.lit("")), F.lit("(none)"))
    author = found.where(display.likely_author(F.col("author"))).groupBy(F.trim("author").alias("name")).agg(F.sum("files").alias("n"))
    no_cover = (F.coalesce("thumbnail", F.lit("")) == "") & F.arrays_overlap("extensions", F.array(*map(F.lit, (".epub", ".zip", ".cbz"))))
    todo = found.agg(F.count_if("duplicates").alias("duplicate"), F.count_if(F.size("extensions") > 1).alias("mixed"), F.count_if(no_cover).alias("no cover"), F.count("*").alias("works"), F.coalesce(F.sum("removable"), F.lit(0)).alias("removable"))
    todo = todo.crossJoin(items.agg(F.count("*").alias("files")))  # one row each
    counts = todo.select(F.explode(F.create_map(*(x for c in todo.columns for x in (F.lit(c), F.col(c).cast("long"))))).alias("name", "n"))
    totals = counts.where(F.col("name").isin("works", "files", "removable"))
    parts = [panel("total", totals, 3), panel("extension", items.groupBy(ext.alias("name")).agg(F.count("*").alias("n"))), panel("author", author), panel("largest", found.where("duplicates").select(F.col("title").alias("name"), F.col("files").alias("n")))]
    out = panel("todo", counts.where(~F.col("name").isin("works", "files", "removable") & (F.col("n") > 0)), 3)
    for p in parts:
        out = out.unionByName(p)
    return out


def recommendations(found: DataFrame, most: int = 9) -> DataFrame:
    """Works with a favorite mark, a rating or tags and a readable title: favorites first, then by rating. A top-`most` report."""
    said = F.coalesce("favorite", F.lit(False)) | (F.trim(F.coalesce("rating", F.lit(""))) != "") | (F.trim(F.coalesce("user_tags", F.lit(""))) != "")
    readable = ~F.col("title").rlike("(?i)^%u[0-9a-f]{4}") & ~F.col("title").contains("�")
    return found.where(said & readable).orderBy(F.coalesce("favorite", F.lit(False)).desc(), F.coalesce(F.col("rating").try_cast("double"), F.lit(0.0)).desc(), "title").limit(most)


def latest_candidates(found: DataFrame, most: int = 200) -> DataFrame:
    """Works with something to compare, the latest first. A top-`most` report."""
    return found.where(F.col("duplicates") | (F.size("extensions") > 1)).orderBy(F.desc("latest_episode"), F.desc("files"), "title").limit(most)


# --- lists against a library ---------------------------------------------------------------------------------------


def substring_pairs(long: DataFrame, long_key: str, short: DataFrame, short_key: str) -> DataFrame:
    """(long_key, short_key): pairs of which the one holds the other. Distinct keys; empty ones hold and lie in nothing.

    The short keys are dealt into blocks of bounded size, the long ones into shares. A task builds the automaton of a block (Aho-Corasick)
    and runs its share through it once, so the work grows with the length of the keys, whatever lengths occur and however many match.
    """
    inner = short.select(F.col(short_key).alias("key")).where("key <> ''").distinct()
    outer = long.select(F.col(long_key).alias("key")).where("key <> ''").distinct()
    chars = lambda df: df.agg(F.coalesce(F.sum(F.length("key")), F.lit(0))).first()[0]
    blocks, shares = 1 + chars(inner) // BLOCK_CHARS, 1 + chars(outer) // SHARE_CHARS
    parts = max(1, int(long.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = max(shares, min(parts, 1 + chars(outer) // LEAST_SHARE))
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    own = lambda name, n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias(name)
    texts = outer.select("key", own("share", shares), every("block", blocks)).groupBy("share", "block")
    keys = inner.select("key", every("share", shares), own("block", blocks)).groupBy("share", "block")

    def search(texts: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        if texts.empty or keys.empty:
            return pd.DataFrame({long_key: [], short_key: []}, dtype=str)
        automaton = ahocorasick.Automaton()
        for k in keys["key"]:
            automaton.add_word(k, k)
        automaton.make_automaton()
        found = [(t, k) for t in texts["key"] for k in {k for _, k in automaton.iter(t)}]
        return pd.DataFrame(found, columns=[long_key, short_key])

    return texts.cogroup(keys).applyInPandas(search, f"`{long_key}` string, `{short_key}` string")


def rejected(found: DataFrame, rejects: DataFrame, title: str = "title", reject: str = "reject") -> DataFrame:
    """Works of which the title holds a rejected one."""
    low = found.withColumn("_k", F.lower(title))
    hits = substring_pairs(low, "_k", rejects.select(F.lower(F.trim(reject)).alias("_r")), "_r").select("_k").distinct()
    return low.join(hits, "_k", "left_semi").drop("_k")


def track(found: DataFrame, title: str, keywords: DataFrame) -> DataFrame:
    """Works whose title contains a keyword."""
    hits = substring_pairs(found, title, keywords, "keyword")
    return found.join(hits, title)


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; a single character stands for itself."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))


def bigram_similarity(a: Column, b: Column) -> Column:
    """Dice coefficient of the letter pairs of two keys; a key within the other counts 0.98, or 0.72 if far shorter."""
    dice = 2.0 * F.size(F.array_intersect(bigrams(a), bigrams(b))) / (F.size(bigrams(a)) + F.size(bigrams(b)))
    ratio = F.greatest(F.length(a), F.length(b)) / F.least(F.length(a), F.length(b))
    inside = a.contains(b) | b.contains(a)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 0.98).when(inside & (ratio > 2.4), 0.72).when(inside, 0.98).otherwise(dice)


def track_alike(found: DataFrame, keywords: DataFrame, least: float = 0.82) -> DataFrame:
    """(keyword, key, score): works of which the text (column `haystack`, lower-cased) holds a keyword, or title or author are like it.

    Likeness of `least` needs that share of common letter pairs, so only keys that share a rare enough pair are compared:
    of the pairs of a keyword, rarest first, one of the first (1 - least / (2 - least)) share and one more must be common.
    """
    words = keywords.select("keyword").distinct().withColumn("low", F.lower(F.trim("keyword"))).where("low <> ''").withColumn("k", display.compact(F.col("keyword")))
    held = substring_pairs(found, "haystack", words, "low").join(words, "low").join(found.select("haystack", "key"), "haystack").select("keyword", "key", F.lit(1.0).alias("score"))
    texts = found.select("key", display.compact(F.col("title")).alias("t")).unionByName(found.select("key", display.compact(F.col("author")).alias("t"))).where("t <> ''").distinct()
    pairs = texts.select("t").distinct().select("t", F.explode(bigrams(F.col("t"))).alias("g"))
    seen = pairs.groupBy("g").agg(F.count("*").alias("n"))
    own = words.where("k <> ''").select("k").distinct().select("k", F.explode(bigrams(F.col("k"))).alias("g")).join(seen, "g", "left")
    ranked = own.groupBy("k").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))).alias("gs"))
    probes = ranked.select("k", F.explode(F.slice("gs", F.lit(1), F.floor(F.size("gs") * (1 - least / (2 - least))).cast("int") + 1)).alias("p")).select("k", "p.g")
    near = probes.join(pairs, "g").select("k", "t").distinct()
    # One key within the other counts 0.98 where it is not far shorter.
    inside = substring_pairs(texts, "t", words, "k").select("k", "t").unionByName(substring_pairs(words.where("k <> ''"), "k", texts, "t").select("k", "t"))
    scored = near.unionByName(inside).distinct().withColumn("score", bigram_similarity(F.col("k"), F.col("t"))).where(F.col("score") >= least)
    alike = scored.join(words.select("keyword", "k"), "k").join(texts, "t").select("keyword", "key", "score")
    return held.unionByName(alike).groupBy("keyword", "key").agg(F.max("score").alias("score"))


def against_library(wanted: DataFrame, key: str, owned: DataFrame, rejects: DataFrame) -> DataFrame:
    """`wanted` with status owned, rejected or new: keys that contain, or lie within, a key of the two lists (column `key`)."""
    mine = wanted.select(F.col(key).alias("_w")).distinct()

    def hit(library: DataFrame, name: str) -> DataFrame:
        other = library.select(F.col("key").alias("_k")).distinct()
        met = substring_pairs(mine, "_w", other, "_k").select("_w").unionByName(substring_pairs(other, "_k", mine, "_w").select("_w"))
        return met.distinct().select(F.col("_w").alias(key), F.lit(True).alias(name))

    out = wanted.join(hit(owned, "_o"), key, "left").join(hit(rejects, "_r"), key, "left")
    return out.withColumn("status", F.when(F.col("_o"), "owned").when(F.col("_r"), "rejected").otherwise("new")).drop("_o", "_r")


# --- text profiles -------------------------------------------------------------------------------------------------


def storage_profile(text: Column) -> list[Column]:
    """Counts of line feeds, carriage returns, spaces and lines."""
    count = lambda c: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("long")
    return [count("\n").alias("lf"), count("\r").alias("cr"), count(" ").alias("spaces"), (count("\n") + 1).alias("lines")]


LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def line_profile(text: Column) -> list[Column]:
    """Line ends by kind, spaces and tabs before them, and invisible characters by code point."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    code = lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.conv(F.hex(F.encode(c, "utf-32")), 16, 10).cast("long")), 4, "0"))
    invisible = F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{Cf})"), F.lit(1)), code))
    distinct = F.array_distinct(invisible)
    trailing = F.regexp_extract_all(text, F.lit(rf"([ \t]+)(?={LINE_ENDS}|\z)"), F.lit(1))
    return [
        count("\r\n").alias("crlf"), count("(?<!\r)\n").alias("lf"), count("\r(?!\n)").alias("cr"),
        F.aggregate(trailing, F.lit(0).cast("long"), lambda a, t: a + F.length(t)).alias("trailing_spaces"), F.size(invisible).cast("long").alias("invisible_count"),
        F.transform(distinct, lambda d: F.concat(d, F.lit(": "), F.size(F.filter(invisible, lambda x: x == d)))).alias("invisible"),
    ]


def stored_alike(text: Column) -> Column:
    """SHA-256 of the text without invisible characters and spaces at line ends, with line feeds alone."""
    bare = F.regexp_replace(text, r"[\p{Cf}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]", "")
    return F.sha2(F.regexp_replace(F.regexp_replace(bare, "\r\n?", "\n"), r"[ \t]+(?=\n|\z)", ""), 256)


def numbered_names(files: DataFrame, start: int = 0) -> DataFrame:
    """`files` with `index`, their place from `start` by lower-cased path."""
    ranked = grouping.ranked(files.withColumn("_low", F.lower("path")), ["_low", "path"], "index")
    return ranked.withColumn("index", (F.col("index") - 1 + start).cast("long")).drop("_low")


def natural_key(name: Column) -> Column:
    """A key that orders digit runs by value."""
    return names.natural_key(name)

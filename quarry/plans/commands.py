"""The user-visible commands as plans over files and archive members: each is a function of DataFrames and options.

Files are (path, size, modified[, content]). Members of archives come in by the rows of the `archive` source, as
`quarry.sources.items` makes them: (location, path, inner, kind, name, extension, size, modified[, content]).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import content, display, names, rename
from quarry.functions.text import decoded, normalise, sentence_fingerprint
from quarry.operators import grouping, library, matching
from quarry.operators.components import connected_components
from quarry.operators.joins import join_totals
from quarry.session import materialize
from quarry.sources.files import matches

BROADCAST_ROWS = 100_000
TEXT_EXTENSIONS = (".txt", ".html", ".htm", ".xhtml", ".xml", ".epub")
LATEST = "9999-12-31 23:59"  # stands for a time that is none
Fetch = Callable[[DataFrame], DataFrame]  # items (location, path, inner, ..) to the same rows with sha256 and content


def read_items(items: DataFrame, wanted: DataFrame, fetch: Fetch | None = None) -> DataFrame:
    """`wanted` (location, path, inner, ..) with sha256 and content.

    `fetch`, as `archive.contents`, opens what is wanted and nothing else. Without it, items bring their content along.
    """
    if fetch is not None:
        return fetch(wanted)
    wanted = materialize(wanted, "wanted")
    some = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return items.select("location", "content").join(some, "location").withColumn("sha256", F.sha2("content", 256))


def as_items(files: DataFrame) -> DataFrame:
    """Files as items; what are items already stays."""
    if "location" in files.columns:
        return files
    last = F.regexp_replace("path", r"^.*[/\\]", "")
    return files.withColumns({"location": F.col("path"), "inner": F.lit(""), "kind": F.lit("file"), "name": last, "extension": names.extension(last)})


def catalog(files: DataFrame, limit: int = 0, query: str = "") -> DataFrame:
    """Files and members with all name fields, by lower-cased location; `query` keeps what it matches."""
    out = as_items(files).withColumns({"f": names.name_fields("name"), "size_text": names.size_text(F.col("size"))})
    out = out.where(matches(query, F.col("name"), F.col("f.title"), F.col("extension"), F.col("location")))
    out = out.select("path", "location", "kind", "name", "extension", "size", "size_text", "modified", "f.*").orderBy(F.lower("location"), "location")
    return out.limit(limit) if limit else out


def enriched(found: DataFrame, with_content: DataFrame | None = None) -> DataFrame:
    """A catalog with `smart` fields, the title, series and author to show, and whether the title was found inside the file.

    Only rows whose names say nothing have their content (location, content) read: titles, and series without their source tags, are both looked at.
    """
    out = rename.with_smart_fields(found)
    shown = names.name_fields(F.coalesce(F.nullif("smart.stem", F.lit("")), F.col("name")))
    out = out.withColumn("_f", shown).withColumns({"shown_title": F.col("_f.title"), "shown_series": F.col("_f.series"), "shown_author": F.col("smart.writer")})
    out = out.withColumn("_lost", names.says_nothing(F.col("shown_title")) | names.says_nothing(F.col("shown_series")))
    if with_content is None:
        return out.withColumn("title_from_content", F.lit(False)).drop("_f", "_lost")
    lost = materialize(out.where("_lost").select("location", "extension"), "lost")
    read = with_content.select("location", "content").join(F.broadcast(lost) if lost.count() <= BROADCAST_ROWS else lost, "location")
    inside = read.select("location", content.recovered_title("content", "extension").alias("t")).where("t <> ''").withColumn("_in", names.name_fields("t")).select("location", F.col("_in.title").alias("_t"), F.col("_in.series").alias("_s"))
    out = out.join(inside, "location", "left").withColumn("title_from_content", F.col("_t").isNotNull())
    return out.withColumns({"shown_title": F.coalesce("_t", "shown_title"), "shown_series": F.coalesce("_s", "shown_series")}).drop("_f", "_lost", "_t", "_s")


def authors(found: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(location, author) for a catalog: what the book itself states (`own`: location, creator), else what most files of the
    title say, else most of the series."""
    said = found.where("author <> ''")
    by_title = grouping.modes(said, "title_key", "author").select("title_key", F.col("author").alias("_t"))
    by_series = grouping.modes(said, "series_key", "author").select("series_key", F.col("author").alias("_s"))
    out = found.select("location", F.nullif("title_key", F.lit("")).alias("title_key"), F.nullif("series_key", F.lit("")).alias("series_key")).join(by_title, "title_key", "left").join(by_series, "series_key", "left")
    mine = F.lit(None).cast("string")
    if own is not None:
        out, mine = out.join(own.where("creator <> ''").groupBy("location").agg(F.min("creator").alias("_m")), "location", "left"), F.col("_m")
    return out.select("location", F.coalesce(mine, "_t", "_s", F.lit("")).alias("author"))


def rename_plan(files: DataFrame, options: rename.Options, own: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """(path, source, target, status, error): the new names of files by lower-cased path, numbered in that order.

    Authors that a name does not state come from the book, its title's or its series' other files. `existing` (name) are files beside
    the plan. Statuses are those of `library.rename_status`; a pattern that is none is a status, not a failure.
    """
    found = library.numbered_names(as_items(files))
    hints = authors(catalog(files), own).withColumnRenamed("author", "hint") if options.auto_author else found.select("location", F.lit("").alias("hint"))
    planned = found.join(hints, "location", "left").withColumn("p", rename.planned(F.col("name"), F.col("index"), F.coalesce("hint", F.lit("")), options))
    plan = materialize(planned.select("path", F.col("name").alias("source"), "p.target", "p.error"), "plan")
    return library.rename_status(plan, existing)


def titles(files: DataFrame, query: str = "") -> DataFrame:
    """Groups of equal title key and extension, of which a whole group stays if the query matches any row.

    Of each the largest file is kept, files before members, of equal ones that of the shortest location.
    """
    found = materialize(catalog(files).where("title_key <> ''"), "titles")
    groups = grouping.groups_of(found, "title_key", "extension")
    if query.strip():
        groups = grouping.whole_groups_matching(groups, ["title_key", "extension"], matches(query, F.col("name"), F.col("title"), F.col("extension"), F.col("location")))
    kept = grouping.survivor(groups, ["title_key", "extension"], [F.col("kind") != "file", ("size", "desc"), F.length("location"), "location"])
    return grouping.numbered(kept, ["title_key", "extension"], [F.min(F.lower("title"))])


def group_order(group: str = "grp", keep: str = "keep", location: str = "location") -> list[Column]:
    """Groups by number, what is kept first, then by lower-cased location."""
    return [F.col(group), F.desc(keep), F.lower(location), F.col(location)]


def text_prints(files: DataFrame, least: int = 30) -> DataFrame:
    """(location, path, kind, extension, size, fingerprint, sentences, preview) of items with `least` characters of text; the text stays behind.

    Text of books is that of their text members.
    """
    found = as_items(files).where(F.col("extension").isin(*TEXT_EXTENSIONS))
    raw = F.when(F.col("extension") == ".epub", content.epub_body("content")).otherwise(decoded("content"))
    body = found.withColumn("body", normalise(raw)).where(F.length("body") >= least)
    prints = body.withColumn("f", sentence_fingerprint("body"))
    return prints.select("location", "path", "kind", "extension", "size", F.col("f.fingerprint").alias("fingerprint"), F.col("f.n").alias("sentences"), F.col("f.preview").alias("preview"))


def text_duplicates(files: DataFrame, least: int = 30, cached: DataFrame | None = None, query: str = "", allowed: DataFrame | None = None, fetch: Fetch | None = None) -> DataFrame:
    """Groups of equal sentence fingerprints over files and members; EPUBs stay first, then the largest, then by location.

    `cached` are prints of earlier runs; their items are not read again. `allowed` (location) are the only items to look at. With
    `fetch`, only what is left is opened. The query filters rows after grouping.
    """
    items = as_items(files)
    if allowed is not None:
        items = items.join(allowed.select("location").distinct(), "location", "left_semi")
    fresh = items
    if cached is not None:
        fresh = fresh.join(cached.select("location", "size"), ["location", "size"], "left_anti")
    if fetch is not None:
        entry = [c for c in ("entry",) if c in fresh.columns]
        fresh = fetch(fresh.where(F.col("extension").isin(*TEXT_EXTENSIONS)).select("location", "path", "inner", *entry, "kind", "name", "extension", "size"))
    prints = text_prints(fresh, least)
    if cached is not None:
        prints = prints.unionByName(cached.join(items.select("location", "size"), ["location", "size"], "left_semi").select(*prints.columns))
    prints = materialize(prints, "prints")
    kept = grouping.survivor(grouping.groups_of(prints, "fingerprint"), ["fingerprint"], [F.col("extension") != ".epub", ("size", "desc"), "location"])
    return kept.where(row_query(query, "location", "extension", "preview"))


def row_query(query: str, *columns: str) -> Column:
    """A query on rows after grouping: part of any column."""
    q = query.strip().casefold()
    out = F.lit(not q)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(q), F.lit(False))
    return out


def size_duplicates(files: DataFrame, kilobytes: float = 4, with_content: DataFrame | None = None) -> DataFrame:
    """Groups of equal size, numbered by size, with the health of archives where their content (location, content) is given."""
    found = as_items(files).where(F.col("size") >= int(kilobytes * 1024)).select("location", "name", "extension", "size")
    groups = grouping.numbered(grouping.groups_of(found, "size"), ["size"], [F.first("size")])
    return groups if with_content is None else with_health(groups, with_content)


def with_health(rows: DataFrame, with_content: DataFrame) -> DataFrame:
    """`rows` (location, extension) with `health`: whether archives open. Content of other files is not read."""
    some = rows.where(F.col("extension").isin(".zip", ".cbz", ".epub")).select("location", "extension").distinct()
    health = with_content.select("location", "content").join(some, "location").select("location", content.archive_health("content", "extension").alias("health"))
    return rows.join(health, "location", "left")


def content_duplicates(files: DataFrame, kilobytes: float = 4, fetch: Fetch | None = None) -> DataFrame:
    """Groups of equal content and extension, numbered by extension and hash; only sizes that occur twice are hashed, and with `fetch` opened."""
    found = as_items(files).where(F.col("size") >= int(kilobytes * 1024))
    entry = [c for c in ("entry",) if c in found.columns]
    candidates = grouping.groups_of(found.select("location", "path", "inner", *entry, "name", "extension", "size"), "size").drop("copies")
    hashed = read_items(found, candidates, fetch).select("location", "name", "extension", "size", F.col("sha256").alias("sha"))
    same = grouping.groups_of(materialize(hashed.where("sha IS NOT NULL"), "hashed"), "size", "sha", "extension")
    return grouping.numbered(same, ["extension", "sha"], [F.first("extension"), F.first("sha")])


def linked_by_keys(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) and (node, evidence) over (node, key), of which each key begins with its kind of evidence and a zero character."""
    linked = grouping.groups_of(keyed, "key")
    evidence = linked.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set(F.substring_index("key", "\0", 1))), ", ").alias("evidence"))
    edges = linked.join(linked.groupBy("key").agg(F.min("node").alias("head")), "key").select(F.col("node").alias("a"), F.col("head").alias("b"))
    return connected_components(edges), evidence


def comprehensive(files: DataFrame, query: str = "", fetch: Fetch | None = None) -> DataFrame:
    """Components over equal titles, equal content and equal bodies of files and members, with evidence, survivor and verdict.

    Groups of equal content or body whose names state different volumes fall apart first. Only rows of equal titles
    have their bodies compared, and only rows of equal sizes are hashed; with `fetch` nothing else is opened. In a group with files
    and members a member is kept before a file; of equals the oldest, then the first by lower-cased location. Members are never selected.
    """
    items = as_items(files)
    entry = F.col("entry") if "entry" in items.columns else F.lit(None).cast("int")
    named = items.select("path", "location", "inner", "kind", "size", "modified", "extension", "name", entry.alias("entry"))
    named = materialize(named.withColumn("f", names.name_fields("name")).select("*", "f.title", "f.title_key", "f.signature").drop("f", "name"), "named")
    base = materialize(grouping.ranked(named, ["location"], "node"), "items")
    # What has to be read: content of sizes that occur twice, bodies of titles that do. Only digests of it go on.
    sizes = base.groupBy("size").agg((F.count("*") > 1).alias("need_hash"))
    alike = base.where("title_key <> ''").groupBy("title_key").agg((F.count("*") > 1).alias("need_body"))
    wanted = base.join(sizes, "size").join(alike, "title_key", "left").select("location", "path", "inner", "entry", "node", F.col("extension").alias("ext"), "need_hash", F.coalesce("need_body", F.lit(False)).alias("need_body")).where("need_hash OR need_body")
    read = read_items(items, wanted, fetch)
    text = F.when(F.col("need_body") & (F.col("ext") == ".epub"), content.epub_body("content")).otherwise(decoded(F.when(F.col("need_body"), F.col("content"))))
    facts = read.select("node", F.when(F.col("need_hash"), F.col("sha256")).alias("hash"), normalise(F.when(F.col("need_body"), text)).alias("body"))
    facts = materialize(facts.select("node", "hash", sentence_fingerprint(F.when(F.length("body") >= 30, F.col("body"))).alias("f")).select("node", "hash", F.col("f.fingerprint").alias("body")), "facts")
    with_hash = base.join(facts, "node", "left")
    title = base.where("title_key <> ''").select("node", F.concat_ws("\0", F.lit("title"), "title_key", "extension").alias("key"), F.lit("").alias("signature"))
    same_bytes = with_hash.where("hash IS NOT NULL").select("node", F.concat_ws("\0", F.lit("hash"), "hash", "extension").alias("key"), "signature")
    body = with_hash.where("body IS NOT NULL").select("node", F.concat_ws("\0", F.lit("body"), "body", "extension").alias("key"), "signature")
    keyed = title.unionByName(same_bytes).unionByName(body)
    parted = materialize(grouping.split_by_volume(keyed, "key", "signature").withColumn("key", F.concat_ws("\0", "key", "part")), "keyed")
    found, evidence = linked_by_keys(parted)
    member = materialize(with_hash.join(found, "node").join(evidence, "node", "left"), "members")
    kinds = member.groupBy("component").agg((F.count_if(F.col("kind") == "file") * F.count_if(F.col("kind") != "file") > 0).alias("mixed"), F.count("*").alias("n"))
    member = join_totals(member, kinds, ["component"], member.count())
    second = F.when(F.col("mixed"), F.col("kind") == "file").otherwise(F.col("kind") != "file")
    when = F.coalesce(F.date_format("modified", "yyyy-MM-dd HH:mm"), F.lit(LATEST))
    kept = materialize(grouping.survivor(materialize(member, "mixed"), ["component"], [second, when, F.lower("location"), F.col("location")]), "kept")
    heads = kept.groupBy("component").agg(F.max(F.when(F.col("keep"), F.col("hash"))).alias("keep_hash"), F.max(F.when(F.col("keep"), F.col("extension"))).alias("keep_extension"), F.min(F.lower("title")).alias("first_title"), F.count("*").alias("n"))
    out = join_totals(kept, heads, ["component"], kept.count())
    return verdicts(out).where(row_query(query, "location", "evidence")).select("path", "location", "kind", "component", "first_title", "keep", "evidence", "hash", "confidence", "verdict", "auto_select")


def verdicts(rows: DataFrame) -> DataFrame:
    """Rows (keep, hash, extension, keep_hash, keep_extension, evidence, kind) with confidence, verdict and auto_select.

    What is kept is certain if it has a hash; copies of it are certain duplicates; rows with a hash that others share but
    the kept one does not are for review, and say so; so are all others.
    """
    same = F.coalesce((F.col("hash") == F.col("keep_hash")) & (F.col("extension") == F.col("keep_extension")), F.lit(False))
    certain = F.when(F.col("keep"), F.col("hash").isNotNull()).otherwise(same)
    unlike = ~F.col("keep") & ~same & F.coalesce(F.col("evidence").contains("hash"), F.lit(False))
    return rows.withColumns(
        {
            "confidence": F.when(certain, "certain").otherwise("review"), "verdict": F.when(F.col("keep"), "keep").when(same, "duplicate").otherwise("review"),
            "auto_select": same & ~F.col("keep") & (F.col("kind") == "file"), "evidence": F.when(unlike, F.concat("evidence", F.lit(", other hash than kept"))).otherwise(F.col("evidence")),
        }
    )


def rechosen_verdicts(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of `comprehensive` (with extension) with survivors that the user names (component, location), and verdicts from them anew."""
    again = grouping.rechosen(rows.withColumn("evidence", F.regexp_replace("evidence", ", other hash than kept$", "")), "component", "location", chosen)
    heads = again.groupBy("component").agg(F.max(F.when(F.col("keep"), F.col("hash"))).alias("keep_hash"), F.max(F.when(F.col("keep"), F.col("extension"))).alias("keep_extension"), F.count("*").alias("n"))
    return verdicts(join_totals(again, heads, ["component"], again.count())).drop("keep_hash", "keep_extension")


def with_group_starts(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` in the order with `starts`: whether the row before is of another group. Every range of rows also knows the last row before it."""
    placed = materialize(grouping.ranked(rows, order, "place"), "placed")
    before = placed.select((F.col("place") + 1).alias("place"), F.col(group).alias("_before"), F.lit(True).alias("_there"))
    return placed.join(before, "place", "left").withColumn("starts", F.col("_there").isNull() | ~F.col(group).eqNullSafe(F.col("_before"))).drop("_before", "_there")


def comprehensive_stats(rows: DataFrame) -> DataFrame:
    """One row of counts over the result."""
    return rows.agg(
        F.count("*").alias("rows"), F.count_distinct("component").alias("groups"), F.count_if(F.col("confidence") == "certain").alias("certain"), F.count_if("auto_select").alias("selectable"),
        F.count_if(F.col("evidence").contains("title")).alias("title"), F.count_if(F.col("evidence").contains("hash")).alias("hash"), F.count_if(F.col("evidence").contains("body")).alias("body"),
    )


def listed(found: DataFrame) -> DataFrame:
    """A catalog in the order of lists: series, kind of file, part, number, name."""
    return found.orderBy(*display.catalog_order(F.col("series"), F.col("extension"), F.col("name")), "location")

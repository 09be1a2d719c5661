"""Manifests of a collection: their files, their reconciliation, and plans of moves that were checked again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import names
from quarry.operators import grouping
from quarry.operators.joins import join_totals
from quarry.session import materialize
from quarry.sources import sink
from quarry.sources.items import at_least, items

KIND, VERSION = "quarry-manifest", 1
ENTRY = "name string, title string, extension string, size long, sha256 string, crc32 string, location string"


def entries(files: DataFrame, location: str, content: str) -> DataFrame:
    """(location, size, crc32, sha256) of each file."""
    data = F.col(content).cast("binary")
    return files.select(F.col(location).alias("location"), F.octet_length(data).cast("long").alias("size"), F.lpad(F.lower(F.hex(F.crc32(data))), 8, "0").alias("crc32"), F.sha2(data, 256).alias("sha256"))


def scan_entries(rows: DataFrame, kilobytes: float = 0, with_members: bool = True) -> DataFrame:
    """ENTRY for rows of the `archive` source with content: files with both digests, members with the CRC32 of the directory alone.

    With members, archives stand for their members.
    """
    found = at_least(items(rows), kilobytes).withColumn("title", names.name_fields("name")["title"])
    archive = (F.col("kind") == "file") & F.col("extension").isin(".zip", ".cbz")
    kept = found.where(~archive) if with_members else found.where("kind = 'file'")
    crc = F.when(F.col("kind") == "file", F.lpad(F.lower(F.hex(F.crc32("content"))), 8, "0")).otherwise(F.col("crc32"))
    sha = F.when(F.col("kind") == "file", F.col("sha256")).otherwise("")
    return kept.select("name", "title", "extension", "size", sha.alias("sha256"), crc.alias("crc32"), "location")


def save(found: DataFrame, path: str, **header) -> None:
    """Write ENTRY rows with a header in a folder; a write that fails leaves no manifest."""
    sink.write(found.select(*(c.split()[0] for c in ENTRY.split(", "))), path, {"kind": KIND, "version": VERSION, **header})


def load(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(header, ENTRY rows) of a saved manifest or of one JSON-lines file whose first line is the header.

    A line that is no object fails with its file and number; a file without a header is no manifest.
    """
    if sink.document_of(path) is not None:
        return sink.read(spark, path, KIND)
    first = spark.read.text(path, wholetext=False).limit(1).collect()
    try:
        header = json.loads(first[0][0]) if first else {}
    except json.JSONDecodeError:
        header = {}
    if not isinstance(header, dict) or header.get("kind") != KIND:
        raise ValueError(f"{path} is no manifest: its first line is no header")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = lines.where((F.trim("value") != "") & (F.get_json_object("value", "$.kind").isNull() | (F.get_json_object("value", "$.kind") != KIND)))
    parsed = lines.select("file", "block", "at", F.from_json("value", ENTRY + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("e"))
    bad = parsed.where("e._bad IS NOT NULL").agg(F.min(F.struct("file", "block", "at"))).first()[0]
    if bad is not None:
        # Lines of one split have rising numbers, and splits of a file are ordered by where they start.
        text = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
        before = text.where((F.col("file") == bad["file"]) & ((F.col("block") < bad["block"]) | ((F.col("block") == bad["block"]) & (F.col("at") <= bad["at"])))).count()
        raise ValueError(f"{bad['file']}, line {before}: not a manifest entry")
    return header, parsed.select("e.*").drop("_bad")


def first_by_hash(manifest: DataFrame) -> DataFrame:
    """(sha256, first): of entries with equal hash the one of the lowest location."""
    names_of = [c for c in ("location", "name") if c in manifest.columns]
    return manifest.where("sha256 <> ''").groupBy("sha256").agg(F.min(F.struct(*names_of)).alias("first"))


def check(files: DataFrame, location: str, content: str, manifest: DataFrame) -> DataFrame:
    """(location, status, matched): have or new, by SHA-256.

    Sizes and CRC32 sort out first what can't be in the manifest, so only likely rows are hashed; of equal entries the
    first location counts.
    """
    data = F.col(content).cast("binary")
    cheap = files.select(F.col(location).alias("location"), F.octet_length(data).cast("long").alias("size"), F.lpad(F.lower(F.hex(F.crc32(data))), 8, "0").alias("crc32"), data.alias("_data"))
    likely = cheap.join(manifest.select("size", "crc32").distinct(), ["size", "crc32"], "left_semi").select("location", F.sha2("_data", 256).alias("sha256"))
    first = first_by_hash(manifest).select("sha256", F.col("first.location").alias("matched"))
    hits = likely.join(first, "sha256").groupBy("location").agg(F.min("matched").alias("matched"))  # a location that occurs again has one
    return files.select(F.col(location).alias("location")).join(hits, "location", "left").select("location", F.when(F.col("matched").isNull(), "new").otherwise("have").alias("status"), "matched")


def check_scan(rows: DataFrame, manifest: DataFrame, kilobytes: float = 0, verify: bool = True) -> DataFrame:
    """(location, name, status, matched, note) of files and members against ENTRY rows: have, new, or self (the very file of the manifest).

    `rows` come from the `archive` source, hashed. A member whose size and CRC32 no entry has is new without a look at
    its hash. Where entries with them have no hash, or without `verify`, size and CRC32 are enough.
    """
    found = at_least(items(rows), kilobytes).where(~((F.col("kind") == "file") & F.col("extension").isin(".zip", ".cbz")))
    by_hash = first_by_hash(manifest).select("sha256", F.col("first.location").alias("ref"), F.col("first.name").alias("ref_name"))
    by_crc = manifest.where("crc32 <> ''").groupBy(F.col("size"), F.col("crc32")).agg(F.min(F.struct("location", "name")).alias("alike"), F.bool_or(F.col("sha256") != "").alias("hashed"))
    joined = found.join(by_hash, "sha256", "left").join(by_crc, ["size", "crc32"], "left")
    member, same = F.col("kind") == "zip item", F.col("ref").isNotNull()
    weak = member & F.col("alike").isNotNull() & (~F.col("hashed") | F.lit(not verify))
    unlike = member & F.col("alike").isNull()
    status = F.when(~member & same & (F.col("ref") == F.col("location")), "self").when(weak | (same & ~unlike), "have").otherwise("new")
    note = F.when(weak & ~F.col("hashed"), "size and CRC32").when(weak, "not verified").when(member & ~unlike & ~same, "CRC32 alike, content differs").when(status == "have", "SHA-256").otherwise("")
    matched = F.when(weak, F.col("alike.name")).when(status != "new", F.col("ref_name"))
    return joined.select("location", "name", status.alias("status"), matched.alias("matched"), note.alias("note"))


def check_order() -> list:
    """What is there already first, then by lower-cased location."""
    return [F.col("status") != "have", F.lower("location"), F.col("location")]


def check_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "have").alias("have"), F.count_if(F.col("status") == "new").alias("new"), F.count_if(F.col("status") == "self").alias("self"))


def unique_names(wanted: DataFrame, taken: DataFrame | None = None, name: str = "name", order: str = "location") -> DataFrame:
    """`wanted` with `target`: its name, or the name with the first free number: no two rows and no taken name (column `name`) are equal.

    The first row of each name that is not taken keeps it. Then the others get numbers, leaving out those that fixed names
    use; where two names still come to the same ("a (1)" from "a", and from another row), one gets it and the other goes on.
    """
    rows = materialize(wanted.withColumn("_id", F.monotonically_increasing_id()), "wanted_names")
    used = taken.select(F.col("name").alias(name)).distinct() if taken is not None else rows.select(name).limit(0)
    first = rows.groupBy(name).agg(F.min(F.struct(order, "_id")).alias("f")).join(used, name, "left_anti").select(F.col("f._id").alias("_id"))
    kept = rows.join(first, "_id", "left_semi").withColumn("target", F.col(name))
    fixed = materialize(used.unionByName(kept.select(name)).distinct().withColumnRenamed(name, "target"), "fixed_names")
    left = rows.join(first, "_id", "left_anti")
    base, end = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    done = [kept]
    while True:  # a round gives every row a number of its own among its name; what hits a fixed name takes later numbers
        ranked = materialize(grouping.ranked(left, [name, order, "_id"], "_rank"), "ranked_names")
        starts = ranked.groupBy(name).agg(F.min("_rank").alias("_first"), F.count("*").alias("n"))
        placed = join_totals(ranked, starts, [name], ranked.count()).withColumn("_place", (F.col("_rank") - F.col("_first") + 1).cast("long")).drop("_rank", "_first")
        blocked = fixed.select(F.regexp_extract("target", r"^(.*) \((\d+)\)(\.[^.]*)?$", 1).alias("_b"), F.coalesce(F.regexp_extract("target", r"^(.*) \((\d+)\)(\.[^.]*)?$", 3), F.lit("")).alias("_e"), F.regexp_extract("target", r"^(.*) \((\d+)\)(\.[^.]*)?$", 2).try_cast("long").alias("_n"))
        taken_numbers = blocked.where("_n IS NOT NULL").groupBy("_b", "_e").agg(F.array_sort(F.collect_set("_n")).alias("_numbers"))
        numbered = placed.withColumns({"_b": base, "_e": end}).join(taken_numbers, ["_b", "_e"], "left")
        # The place-th number that is not taken: each taken number up to it moves it on by one.
        free = F.aggregate(F.coalesce("_numbers", F.array().cast("array<bigint>")), F.col("_place"), lambda k, t: F.when((t >= 1) & (t <= k), k + 1).otherwise(k))
        given = materialize(numbered.withColumn("target", F.concat("_b", F.lit(" ("), free, F.lit(")"), "_e")).drop("_place", "_b", "_e", "_numbers"), "given_names")
        clash = given.groupBy("target").agg(F.min(F.struct(order, "_id")).alias("f"), F.count("*").alias("n")).where("n > 1")  # two families that wrote one name
        if not clash.count():
            done.append(given)
            break
        won = given.join(clash.select("target"), "target", "left_anti").unionByName(given.join(clash.select(F.col("f._id").alias("_id")), "_id", "left_semi"))
        won = materialize(won, "won_names")
        done.append(won)
        fixed = materialize(fixed.unionByName(won.select("target")), "fixed_names")
        left = left.join(won.select("_id"), "_id", "left_anti")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("_id")


def verified_moves(wanted: DataFrame, now: DataFrame, root: str, target: str, existing: DataFrame | None = None) -> DataFrame:
    """(location, target, status): a plan to move files (location, size, sha256) after they were checked again.

    Status: outside root, missing, size changed, content changed or ready. Targets that several files want, or that are in
    the target folder already (`existing`, column `name`), get the first free number.
    """
    current = now.select("location", F.col("size").alias("_size"), F.col("sha256").alias("_sha"), F.lit(True).alias("_there"))
    status = (
        F.when(~F.col("location").startswith(root.rstrip("/") + "/"), "outside root")
        .when(F.col("_there").isNull(), "missing")
        .when(F.col("size") != F.col("_size"), "size changed")
        .when(F.col("sha256") != F.col("_sha"), "content changed")
        .otherwise("ready")
    )
    planned = materialize(wanted.join(current, "location", "left").withColumn("status", status).select("location", "status"), "moves")
    ready = planned.where("status = 'ready'").withColumn("name", F.regexp_replace("location", r"^.*/", ""))
    named = unique_names(ready, existing).select("location", F.concat(F.lit(target.rstrip("/") + "/"), "target").alias("target"), "status")
    return named.unionByName(planned.where("status <> 'ready'").select("location", F.lit(None).cast("string").alias("target"), "status"))

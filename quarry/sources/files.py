"""Files of a folder as rows, with or without their bytes, and the filters that scans take."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
SKIPPED_FOLDERS = ("_quarantine", "$recycle.bin", "system volume information", ".dropbox.cache", ".git", "__pycache__", "node_modules", ".thumb-cache")
BOOK_EXTENSIONS = (".azw3", ".cbz", ".doc", ".docx", ".epub", ".htm", ".html", ".mobi", ".pdf", ".rtf", ".txt", ".zip")
ZIP_EXTENSIONS = (".zip", ".cbz")
ZIP_WORDS = ("zip", "압축", "archive")


def scan(spark: SparkSession, folder: str, recursive: bool = True, content: bool = False) -> DataFrame:
    """(path, modified, size[, content]). Without content only the file listing is read.

    The engine's lister leaves out names that begin with an underscore or a dot; `quarry.sources.archive` lists all.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    rows = reader.load(folder)
    return rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), *(["content"] if content else []))


def excluded(text: str) -> tuple[list[str], list[str]]:
    """Folder names and folder paths from a list separated by commas, semicolons or line feeds."""
    items = [i.strip() for i in re.split(r"[,;\n]", text) if i.strip()]
    paths = [i.rstrip("/\\") for i in items if re.search(r"[/\\:]", i)]
    return [i.casefold() for i in items if not re.search(r"[/\\:]", i)], paths


def outside(path: Column, text: str = "", skipped: tuple[str, ...] = SKIPPED_FOLDERS) -> Column:
    """Whether a path lies in none of the excluded folders."""
    names, paths = excluded(text)
    folders = F.slice(F.split(F.lower(path), r"[/\\]"), 1, F.greatest(F.size(F.split(path, r"[/\\]")) - 1, F.lit(0)))
    out = ~F.arrays_overlap(folders, F.array(*map(F.lit, [*skipped, *names])))
    for p in paths:
        out = out & ~((path == p) | path.startswith(p + "/"))
    return out


def allowed_extensions(text: str) -> set[str] | None:
    """Extensions with dots from a free-form list; None is no filter."""
    items = [i.lower() for i in re.split(r"[\s,;/]+", text) if i]
    if not items or {"*", "all"} & set(items):
        return None
    found: set[str] = set()
    for i in items:
        found |= set(ZIP_EXTENSIONS) if i in ZIP_WORDS else {i if i.startswith(".") else f".{i}"}
    return found


def matches(query: str, name: Column, title: Column, extension: Column, location: Column) -> Column:
    """The catalog's query: part of any field, or the extension without its dot."""
    q = query.strip().casefold()
    if not q:
        return F.lit(True)
    inside = [F.lower(c).contains(q) for c in (name, title, extension, location)]
    return inside[0] | inside[1] | inside[2] | inside[3] | (F.ltrim(F.lower(extension), F.lit(".")) == q.lstrip("."))

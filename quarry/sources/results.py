"""Results and records as files: saved with what made them, and read back with checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.library import has_record
from quarry.sources import sink
from quarry.sources.items import any_text_matches

KIND, RECORDS, VERSION = "quarry-result", "quarry-records", 1
RECORD = "key string, title string, rating string, user_tags string, read boolean, favorite boolean, memo string"


def as_json(rows: DataFrame) -> DataFrame:
    """(value): each row as a JSON object, nulls included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def save_result(rows: DataFrame, path: str, command: str, options: dict, limit: int = 0, order: list | None = None) -> dict:
    """Write the first `limit` rows (0: all) with a document of command, options, counts, and whether rows were cut off."""
    total = rows.count()
    shown = (rows.orderBy(*order) if order else rows).limit(limit) if limit else rows
    document = {"kind": KIND, "version": VERSION, "command": command, "options": options, "total": total, "shown": min(total, limit) if limit else total, "truncated": bool(limit) and total > limit}
    sink.write(shown, path, document)
    return document


def load_result(spark: SparkSession, path: str, query: str = "", limit: int = 0) -> tuple[dict, DataFrame]:
    """(document, rows) of a saved result. The query filters the rows that were saved, so a truncated result stays truncated."""
    document, rows = sink.read(spark, path, KIND)
    kept = rows.where(any_text_matches(rows, query))
    total = kept.count()
    document |= {"total": total, "shown": min(total, limit) if limit else total, "loaded_from": path}
    return document, kept.limit(limit) if limit else kept


def export_records(records: DataFrame, path: str, rejects: list[str] = (), tracked: list[str] = ()) -> int:
    """Write the records in which a user entered something, with the lists of rejected and tracked titles; how many."""
    said = records.where(has_record()).select(*(c.split()[0] for c in RECORD.split(", ")))
    sink.write(said, path, {"kind": RECORDS, "version": VERSION, "rejects": list(rejects), "tracked": list(tracked)})
    return sink.document_of(path)["rows"]


def load_records(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(document, RECORD rows) of exported records."""
    return sink.read(spark, path, RECORDS)


def merged_list(own: list[str], incoming: list[str], known: list[str] = ()) -> list[str]:
    """`own` followed by what is new, each once in the order of appearance."""
    seen = {*own, *known}
    return [*dict.fromkeys(own), *dict.fromkeys(x for x in incoming if x not in seen)]

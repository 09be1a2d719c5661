"""Rows with a document, written in two phases: `frame.write.format("documented")`.

Tasks write files under names that are used once. When all have ended well, the driver writes the document, which names them, in one
move: before that there is no result, and files of failed or repeated attempts are in no document. What stood there before
stays readable until the move; if the write fails, the files of this one are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from quarry.sources.ranged import file_system

DOCUMENT, ROWS = "document.json", "rows"


@dataclass
class Written(ds.WriterCommitMessage):
    """What a task wrote."""

    files: list[str]
    rows: int


class DocumentedWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.document = options["path"].rstrip("/"), json.loads(options.get("document", "{}"))
        self.schema, self.overwrite, self.folder = schema.json(), overwrite, f"{ROWS}/{uuid.uuid4().hex}"
        system, folder = file_system(self.path)
        if not overwrite and system.get_file_info(f"{folder}/{DOCUMENT}").type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} holds a result")
        system.create_dir(f"{folder}/{self.folder}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = file_system(self.path)
        name, rows, out = f"{self.folder}/{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if batch.num_rows:
                out = out or pq.ParquetWriter(f"{folder}/{name}", batch.schema, filesystem=system)
                out.write_batch(batch)
                rows += batch.num_rows
        if out is None:
            return Written([], 0)
        out.close()
        return Written([name], rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = file_system(self.path)
        before = document_of(self.path) or {} if self.overwrite else {}
        done = [m for m in messages if m is not None]
        text = json.dumps(self.document | {"rows": sum(m.rows for m in done), "files": sorted(f for m in done for f in m.files), "schema": json.loads(self.schema)}, ensure_ascii=False, default=str)
        part = f"{folder}/{DOCUMENT}.{uuid.uuid4().hex}"
        with system.open_output_stream(part, compression=None) as f:
            f.write(text.encode())
        system.move(part, f"{folder}/{DOCUMENT}")
        self._remove({f.rsplit("/", 1)[0] for f in before.get("files", [])})

    def abort(self, messages: list[Written | None]) -> None:
        """Tasks may have written without having told of it, so the write's folder goes as a whole."""
        self._remove({self.folder})

    def _remove(self, folders: set[str]) -> None:
        system, root = file_system(self.path)
        for f in folders - {ROWS}:
            if system.get_file_info(f"{root}/{f}").type == fs.FileType.Directory:
                system.delete_dir(f"{root}/{f}")


class DocumentedSink(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "documented"

    def writer(self, schema: T.StructType, overwrite: bool) -> DocumentedWriter:
        return DocumentedWriter(dict(self.options), schema, overwrite)


def document_of(path: str) -> dict | None:
    """The document of a written result; None where there is none."""
    system, folder = file_system(path.rstrip("/"))
    name = f"{folder}/{DOCUMENT}"
    if system.get_file_info(name).type != fs.FileType.File:
        return None
    with system.open_input_stream(name, compression=None) as f:
        return json.loads(f.read().decode())


def write(rows: DataFrame, path: str, document: dict, overwrite: bool = False) -> None:
    """Write rows and document; either both are there afterwards or neither."""
    rows.sparkSession.dataSource.register(DocumentedSink)
    text = json.dumps(document, ensure_ascii=False, default=str)
    rows.write.format("documented").mode("overwrite" if overwrite else "append").option("document", text).save(path)


def read(spark: SparkSession, path: str, kind: str) -> tuple[dict, DataFrame]:
    """(document, rows) of what `write` left; ValueError where no document of that kind is."""
    try:
        document = document_of(path)
    except json.JSONDecodeError:
        document = None
    if not isinstance(document, dict) or document.get("kind") != kind:
        raise ValueError(f"{path} is not of kind {kind}")
    schema, files = T.StructType.fromJson(document.pop("schema")), document.pop("files")
    document.pop("rows")
    rows = spark.read.schema(schema).parquet(*(f"{path.rstrip('/')}/{f}" for f in files)) if files else spark.createDataFrame([], schema)
    return document, rows

"""Removal of passages that a document of smaller id holds already, by suffix order over all documents.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id. The order of suffixes is
built column by column over a collection of strings: each round inserts one symbol of every string in front of what has
been inserted, and a stable counting sort of those symbols turns the order of the suffixes one column further right into
that of the new column; the sorted symbols' predecessors are the collection's Burrows-Wheeler transform. Strings that
share 50 bytes from a column on are neighbours in its order, with a common prefix of 50 at least.

Whole documents can't be the strings: there would be as many rounds as the longest document has bytes, each over all
data. So the strings are the surroundings of anchors. An anchor is a 24-byte string with the lowest hash among those
within some 50-byte window; equal windows have equal anchors at equal places, so a shared window shows as a shared
anchor. One pass finds the anchors that two documents share; only those get a row of at most 76 bytes (the windows that
cover an anchor), and rows of equal anchors go to one task, where 76 rounds at most order them exactly, on bytes. What many documents share is thinned out before: a task
passes on one row for each distinct surrounding.

What every step keeps between rounds lies in files that are written and read in sequence: shuffles and tables in the
shared folder.

Defined results: null counts as empty; texts under 50 bytes lose nothing; of equal texts, all but those of the smallest
id go whole; repeated rows with one id get equal results; a null id is never smaller than another, and its document
loses what any document with an id holds.
"""

from __future__ import annotations

import gc
import hashlib
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import pieces
from quarry.llm.jaccard import mix
from quarry.session import materialize

LENGTH = 50
GRAM = 24
SIDE = LENGTH - GRAM  # bytes beside an anchor that a window can reach
WIDTH = GRAM + 2 * SIDE
BROADCAST_ROWS = 100_000
FLUSH_KEYS, FLUSH_ROWS = 250_000, 60_000  # what a task holds before it passes on
NO_ID = (1 << 63) - 1

_U = np.uint64
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_MULTIPLIERS = [_U(m | 1) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each GRAM bytes."""
    h, n, lengths = _TABLE[data], 1, {}
    for m in _MULTIPLIERS[:4]:  # 2, 4, 8, 16 bytes
        h = h[:-n] * m + h[n:]
        h ^= h >> _U(32)
        n *= 2
        lengths[n] = h
    h = lengths[16][: len(data) - GRAM + 1] * _MULTIPLIERS[4] + lengths[8][16:]
    h ^= h >> _U(29)
    return h * _U(0x9FB21C651E98DF25)


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of `width` values."""
    n = 1
    while 2 * n <= width:
        x = op(x[:-n], x[n:])
        n *= 2
    rest = width - n
    return op(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a document's bytes."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    h = _gram_hashes(data)
    w = SIDE + 1
    low = _slide(h, w, np.minimum)  # for each window, the lowest of its grams
    edge = np.zeros(w - 1, _U)
    high = _slide(np.concatenate([edge, low, edge]), w, np.maximum)  # for each gram, the highest of those
    at = np.flatnonzero(h == high)
    return at, h[at]


def contexts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The WIDTH bytes around each anchor, with the first and last column that are inside the document."""
    padded = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(SIDE, np.uint8)])
    block = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[at]
    return block, np.maximum(0, SIDE - at), np.minimum(WIDTH, SIDE + len(data) - at)


def covered(block: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(column, rows) for the rows of which the window at the column also is in a row of a smaller document.

    The collection is built from the last column to the first; `order` is the order of its suffixes from a column on.
    """
    n = len(block)
    columns = np.ascontiguousarray(block.T)
    order = np.arange(n)
    out = []
    for c in range(WIDTH - 1, -1, -1):
        order = order[np.argsort(columns[c][order], kind="stable")]
        if c > SIDE:
            continue
        rows = order[(first[order] <= c) & (last[order] >= c + LENGTH)]
        if len(rows) < 2:
            continue
        window = block[rows, c : c + LENGTH]
        fresh = np.ones(len(rows), bool)  # where the common prefix with the row before is under LENGTH
        fresh[1:] = (window[1:] != window[:-1]).any(axis=1)
        starts = np.flatnonzero(fresh)
        lowest = np.repeat(np.minimum.reduceat(doc[rows], starts), np.diff(starts, append=len(rows)))
        hit = rows[doc[rows] > lowest]
        if len(hit):
            out.append((c, hit))
    return out


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals that overlap or touch."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(fresh)
    return start[at], end[np.append(at[1:], len(start)) - 1]


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _free(df: DataFrame) -> None:
    """Let Spark delete the files of shuffles that nothing refers to any more.

    Twice with a pause: the first time, events of the last query that still wait for listeners may refer to them.
    """
    for _ in range(2):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def _small(df: DataFrame) -> DataFrame:
    """With a broadcast hint if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def repeated_spans(df: DataFrame) -> DataFrame:
    """(id, twin, spans binary): runs of repeated bytes as pairs of 64-bit numbers, for rows (id, twin, text).

    `twin` tells apart rows of one id with different texts. Rows without repeated bytes may be missing.
    """
    parts = 2 * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def find(batches):
        """Anchors of the task's documents. `to` deals a row out: by key where other tasks may know more about it, by id
        where the task has seen that two documents share it; of such a key only its smallest and largest id go by key.
        """
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            key, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((doc, key))
            key, doc = key[order].view(np.int64), doc[order]
            at = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
            size = np.diff(at, append=len(key))
            low, high = doc[at], doc[at + size - 1]
            known = np.repeat(low < high, size)
            ends = at[low < high]
            tops = ends + size[low < high] - 1
            keys = np.concatenate([key[~known], key[ends], key[tops], key[known]])
            docs = np.concatenate([doc[~known], doc[ends], doc[tops], doc[known]])
            flags = np.zeros(len(keys), bool)
            flags[len(keys) - int(known.sum()) :] = True
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(docs), pa.array(flags)], ["key", "id", "known"])

        n = 0
        for b in pieces(batches):
            for i, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = np.unique(anchors(_bytes(text))[1])
                held.append((own, np.full(len(own), i, np.int64)))
                n += len(own)
            if n > FLUSH_KEYS:
                yield from flush()
                n = 0
        if held:
            yield from flush()

    def share(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not got:
            return
        key, doc, known = (np.concatenate(x) for x in zip(*got, strict=True))
        k, d = key[~known], doc[~known]
        order = np.lexsort((d, k))
        k, d = k[order], d[order]
        at = np.flatnonzero(np.diff(k, prepend=k[:1] - 1))
        if len(at):
            several = np.repeat(np.maximum.reduceat(d, at) > np.minimum.reduceat(d, at), np.diff(at, append=len(k)))
            k, d = k[several], d[several]
        key, doc = np.concatenate([k, key[known]]), np.concatenate([d, doc[known]])
        if not len(key):
            return
        order = np.argsort(doc, kind="stable")
        key, doc = key[order], doc[order]
        at = np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1))
        for lo in range(0, len(at), 4096):
            some = at[lo : lo + 4096]
            ends = np.append(at[lo + 1 : lo + 4096], at[lo + 4096] if lo + 4096 < len(at) else len(doc))
            yield pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array([key[s:e].tobytes() for s, e in zip(some, ends, strict=True)], pa.binary())], ["id", "keys"])

    shared = materialize(df.mapInArrow(find, "key long, id long, known boolean").repartition(parts, F.when(F.col("known"), F.xxhash64("id")).otherwise(F.col("key"))).mapInArrow(share, "id long, keys binary"), "shared")
    _free(df)
    by_id = shared.groupBy("id").agg(F.collect_list("keys").alias("keys"))

    def surround(batches):
        """Rows around the shared anchors. A row that equals one of a smaller id in its task needs no other: all its
        windows are covered, and it goes on as a span (without bytes) to the task of its id. So what very many documents
        share reaches the task of its key once from each task, not once from each document.
        """
        held, n = [[] for _ in range(7)], 0

        def flush():
            key, doc, twin, at, first, last = (np.concatenate(c).astype(np.int64) for c in held[:6])
            block = np.concatenate(held[6])
            for column in held:
                column.clear()
            digest = mix(key.view(_U) ^ mix((first * 256 + last).view(_U)))
            for c in range(0, WIDTH, 4):
                digest = mix(digest ^ np.ascontiguousarray(block[:, c : c + 4]).view(np.uint32)[:, 0].astype(_U))
            order = np.lexsort((doc, digest))
            head = np.flatnonzero(np.diff(digest[order], prepend=digest[order][:1] - _U(1)))
            lead = np.empty(len(order), np.int64)
            lead[order] = np.repeat(order[head], np.diff(head, append=len(order)))
            done = (doc > doc[lead]) & (key == key[lead]) & (first == first[lead]) & (last == last[lead]) & (block == block[lead]).all(axis=1)
            strings = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(key), [None, pa.py_buffer(np.ascontiguousarray(block))]).cast(pa.binary())
            strings = pc.if_else(pa.array(done), pa.scalar(None, pa.binary()), strings)
            keep = pa.array(last - first >= LENGTH)
            out = pa.RecordBatch.from_arrays([*map(pa.array, (key, doc, twin, at)), pa.array(first.astype(np.int16)), pa.array(last.astype(np.int16)), strings], ["key", "id", "twin", "at", "first", "last", "bytes"])
            yield out.filter(keep)

        for b in pieces(batches, 64):
            for i, twin, text, keys in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = _bytes(text)
                at, own = anchors(data)
                keep = np.isin(own, np.frombuffer(b"".join(keys), _U))
                at, own = at[keep], own[keep]
                if not len(at):
                    continue
                block, first, last = contexts(data, at)
                for column, value in zip(held, (own.view(np.int64), np.full(len(at), i), np.full(len(at), twin), at, first, last, block), strict=True):
                    column.append(value)
                n += len(at)
            if n > FLUSH_ROWS:
                yield from flush()
                n = 0
        if n:
            yield from flush()

    def order(batches):
        got, spans_of = [], []
        for b in batches:
            ready = pc.is_null(b.column(6))
            easy, hard = b.filter(ready), b.filter(pc.invert(ready))
            if easy.num_rows:
                doc, twin, at, first, last = (easy.column(i).to_numpy().astype(np.int64) for i in range(1, 6))
                spans_of.append((doc, twin, at - SIDE + first, at - SIDE + last))
            if hard.num_rows:
                got.append((*(c.to_numpy() for c in hard.columns[1:6]), np.frombuffer(b"".join(hard.column(6).to_pylist()), np.uint8)))
        if got:
            doc, twin, at, first, last, data = (np.concatenate(x) for x in zip(*got, strict=True))
            del got
            for c, hit in covered(data.reshape(-1, WIDTH), first, last, doc):
                start = at[hit] - SIDE + c
                spans_of.append((doc[hit], twin[hit], start, start + LENGTH))
        if not spans_of:
            return
        owner, twins, start, end = (np.concatenate(x) for x in zip(*spans_of, strict=True))
        place = np.lexsort((start, twins, owner))
        owner, twins, start, end = owner[place], twins[place], start[place], end[place]
        cut = np.flatnonzero((np.diff(owner, prepend=owner[:1] - 1) != 0) | (np.diff(twins, prepend=twins[:1] - 1) != 0))
        spans = []
        for s, e in zip(cut, np.append(cut[1:], len(owner)), strict=True):
            spans.append(np.stack(merge(start[s:e], end[s:e]), axis=1).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(owner[cut]), pa.array(twins[cut]), pa.array(spans, pa.binary())], ["id", "twin", "spans"])

    joined = df.join(by_id, "id").select("id", "twin", "text", "keys")
    around = joined.mapInArrow(surround, "key long, id long, twin long, at long, first short, last short, bytes binary")
    found = materialize(around.repartition(parts, F.when(F.col("bytes").isNull(), F.xxhash64("id")).otherwise(F.col("key"))).mapInArrow(order, "id long, twin long, spans binary"), "spans")
    del joined, around  # else their shuffles stay
    _free(df)
    return found.groupBy("id", "twin").agg(F.collect_list("spans").alias("spans"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) and the `carry` columns, for every row.

    With `as_text`, kept is a string, without the bytes of code points that the removal has cut.
    """
    spark = df.sparkSession
    given = F.col(id_col).cast("long")
    rows = df.select(given.alias("doc_id"), F.coalesce(given, F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"_c_{c}") for c in carry))
    rows = rows.withColumn("twin", F.xxhash64("text"))
    # Of equal texts only those of the smallest id take part; the others are covered whole.
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    every = rows.select("id", "twin", digest.alias("digest"), F.octet_length("text").alias("n"))
    copies = every.where(f"n >= {LENGTH}").join(every.groupBy("digest").agg(F.min("id").alias("first_id")), "digest").where("id > first_id").select("id", "twin").distinct()
    copies = materialize(copies, "copies")
    firsts = rows.select("id", "twin", "text").join(_small(copies), ["id", "twin"], "left_anti")
    spans = materialize(repeated_spans(firsts), "merged")
    marks = spans.select("id", "twin", "spans", F.lit(False).alias("whole")).unionByName(copies.select("id", "twin", F.lit(None).cast("array<binary>").alias("spans"), F.lit(True).alias("whole")))
    names = [f"_c_{c}" for c in carry]
    marked = rows.join(marks, ["id", "twin"], "left").select("doc_id", "text", "spans", "whole", *names)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)

    def cut(batches):
        for b in pieces(batches):
            out = [[] for _ in range(5)]
            for text, spans, whole in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = _bytes(text)
                removed, runs, kept = 0, 0, data
                if whole:
                    removed, runs, kept = len(data), 1, data[:0]
                elif spans:
                    pairs = np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2)
                    start, end = merge(pairs[:, 0], pairs[:, 1])
                    steps = np.zeros(len(data) + 1, np.int8)
                    steps[start] += 1
                    steps[end] -= 1
                    kept = data[np.cumsum(steps[:-1]) == 0]
                    removed, runs = len(data) - len(kept), len(start)
                for column, value in zip(out, (len(data), removed, runs, hashlib.sha256(kept.tobytes()).hexdigest(), kept.tobytes().decode("utf-8", "ignore") if as_text else kept.tobytes()), strict=True):
                    column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if as_text else pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays, *(b.column(4 + i) for i in range(len(names)))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *carry])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept " + ("string" if as_text else "binary") + (f", {kinds}" if kinds else "")
    return marked.mapInArrow(cut, schema)

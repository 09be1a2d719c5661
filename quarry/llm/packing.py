"""Packing by concatenating and cutting.

Every document becomes its token ids followed by an end id. Pass one tokenises each document once, keeps the ids as
16- or 32-bit integers in the shared folder together with the running token count inside its partition, and sums the
tokens of each partition. Prefix sums over those totals (one number for a partition) turn local counts into global
offsets. Pass two cuts every document at the multiples of the window length: a window that crosses documents or
partitions is made of boundary pieces that carry the same sequence number, so no partition needs rows of another.

Only the last window can be short, so padding is below one window over the whole corpus.

Defined results: a null or empty text is the end id alone; repeated rows are packed as often as they occur; an empty
table gives no pieces; rows with equal ids keep the order in which their partition reads them.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import pieces
from quarry.session import materialize

WINDOW = 4096
END_ID = 2
MAX_MEMO = 250_000
_CLOSING = ".,;:!?|*#$%&"
_ODD_SPACE = regex.compile("[\x1c-\x1f]")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class WordTokenizer:
    """Ids of a tokenizer whose pieces never cross white space; words already seen are remembered, up to a number.

    New words of letters (and closing marks behind them) are encoded together: a space, which never occurs in a piece,
    takes the part of the end-of-word mark, so that the merges become byte ranks and the tokens that end in a space end
    a piece. Words of another form, and tokenizers whose file has not the form known here, go through the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if max(self.tokenizer.get_vocab().values()) < 1 << 16 else "I"
        self.memo: dict[str, bytes] = {}
        self.ranks = None
        with open(path, encoding="utf-8") as f:
            self._compile(json.load(f))

    def _compile(self, form: dict) -> None:
        """Byte ranks for the merges: single bytes, bytes that end a word, then the merges in order."""
        import tiktoken

        model, pre = form["model"], (form.get("pre_tokenizer") or {}).get("pretokenizers") or []
        steps = [n["type"] for n in (form.get("normalizer") or {}).get("normalizers") or []]
        known = model.get("type") == "BPE" and model.get("end_of_word_suffix") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
        if not (known and steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre] == ["Split", "ByteLevel"] and pre[0].get("invert") and not pre[1].get("use_regex")):
            return
        letters, end, vocabulary = byte_letters(), model["end_of_word_suffix"], model["vocab"]

        def data(token: str) -> bytes:
            closed = token.endswith(end)
            return bytes(letters[c] for c in (token[: -len(end)] if closed else token)) + b" " * closed

        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        tokens = [*letters, *(c + end for c in letters), *merged]
        ranks: dict[bytes, int] = {}
        id_of, ends = [], []
        for t in tokens:
            if data(t) not in ranks:
                ranks[data(t)] = len(id_of)
                id_of.append(vocabulary[t])
                ends.append(t.endswith(end))
        self.id_of, self.ends = np.array(id_of, np.dtype(self.code)), np.array(ends, bool)
        self.ranks = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _learn_together(self, words: list[str], counts: list[int], text: str) -> None:
        """Encode words of which `text` holds the pieces, `counts` for each, with a space behind every piece."""
        ranks = self.ranks.encode_to_numpy(text.lower(), disallowed_special=())
        ids = self.id_of[ranks].tobytes()
        width = self.id_of.itemsize
        ends = (width * (np.flatnonzero(self.ends[ranks])[np.cumsum(counts) - 1] + 1)).tolist()
        self.memo.update(zip(words, map(ids.__getitem__, map(slice, [0, *ends], ends)), strict=False))

    def _learn(self, words: list[str]) -> None:
        if self.ranks:
            together = [w for w in words if w.isascii() and w.isalpha()]
            counts, pieces = [1] * len(together), [f"{w} " for w in together]
            for w in words:
                if not (w.isascii() and w.isalpha()):
                    core = w.rstrip(_CLOSING)
                    # Other letters may be changed by normalising, or lower-cased by their neighbours.
                    if core.isascii() and core.isalpha() or core.isalpha() and max(core) < "\u0370" and "\u0130" not in core:
                        together.append(w)
                        counts.append(1 + (core != w))
                        pieces.append(f"{core} {w[len(core):]} " if core != w else f"{w} ")
            if together:
                self._learn_together(together, counts, "".join(pieces))
            words = [w for w in words if w not in self.memo]
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.memo[w] = self._pack(e.ids)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Words that none before had are learnt for all texts together."""
        # str.split takes odd spaces for white space, the tokenizer doesn't.
        split = [None if _ODD_SPACE.search(t) else t.split() for t in texts]
        memo = self.memo
        if len(memo) > MAX_MEMO:  # short words are those that come back
            self.memo = memo = {w: b for w, b in memo.items() if len(w) < 7} if len(memo) < 2 * MAX_MEMO else {}
            if len(memo) > MAX_MEMO // 2:
                memo.clear()
        fresh = [w for w in dict.fromkeys(chain.from_iterable(filter(None, split))) if w not in memo]
        if fresh:
            self._learn(fresh)
        return [self._pack(self.tokenizer.encode(t, add_special_tokens=False).ids) if words is None else b"".join(map(memo.__getitem__, words)) for t, words in zip(texts, split, strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_tokenizers: dict[str, WordTokenizer] = {}


def worker_tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def tokenise(df: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, n_tokens, part, before): `before` counts the partition's tokens ahead of the document."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("part"))

    def run(batches):
        t = worker_tokenizer(path)
        end, width, before = array(t.code, [end_id]).tobytes(), 2 if t.code == "H" else 4, 0
        for b in pieces(batches):
            ids = [x + end for x in t.encode_all([x or "" for x in b.column(1).to_pylist()])]
            n = np.array([len(x) // width for x in ids], np.int64)
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary()), pa.array(n), b.column(2), pa.array(starts), pa.array([width] * len(ids), pa.int32())],
                ["doc_id", "ids", "n_tokens", "part", "before", "width"],
            )

    return rows.mapInArrow(run, "doc_id long, ids binary, n_tokens long, part int, before long, width int")


def pack(df: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of all documents."""
    tokens = materialize(tokenise(df, path, end_id, id_col, text_col), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # one number for each partition
    base, at = {}, 0
    for r in sorted(totals):
        base[r["part"]] = at
        at += r["n"]

    def run(batches):
        for b in pieces(batches):
            out = [[] for _ in range(8)]
            for doc_id, ids, n, part, before, width in zip(*(c.to_pylist() for c in b.columns), strict=True):
                begin = base[part] + before
                wide = ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(begin + start, window)
                    length = min(n - start, window - offset)
                    piece = wide[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc_id, start, length, zlib.crc32(piece), n, sequence, offset, piece), strict=True):
                        column.append(value)
                    start += length
            kinds = [pa.int64()] * 7 + [pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return tokens.select("doc_id", "ids", "n_tokens", "part", "before", "width").mapInArrow(run, kinds)

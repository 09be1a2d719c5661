"""Byte-level BPE encoding and decoding.

The merge ranks are compiled into a finite-state transducer that is determinised lazily. A state holds the bytes that
may still begin a longer token (the lookahead, never longer than the longest token) and, for every position inside
that lookahead, the tokens not yet emitted on the best path to it. Reading one byte extends the only path whose last
two tokens are a stable pair under the merges, and tokens shared by all open paths are emitted. States and
transitions are made on first use, kept per worker, and dropped when they exceed a fixed number.

Decoding feeds token bytes in pieces to an incremental UTF-8 state machine, so that a code point split over tokens or
pieces comes out whole.

Defined results: null text counts as empty; an empty text has no ids; rows keep their order and repeats.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import pieces

MAX_TRANSITIONS = 1_500_000
MAX_MEMO = 500_000
DECODE_CHUNK = 8192


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file (base64 token and rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Lazily determinised encoder for single pre-split pieces.

    Pieces and tokens are strings of symbols, one character for each (for byte ranks, the byte's number). `order` is
    the merge order of two adjacent tokens, by default the rank of the token they make.
    """

    def __init__(self, ids_of: dict[str, int], order=None, most: int = MAX_TRANSITIONS, whole: bool = True):
        self.ids_of, self.most, self.whole = ids_of, most, whole
        self.order = order or (lambda a, b: ids_of.get(a + b))
        self.token_of = {i: t for t, i in ids_of.items()}
        self.reachable: dict[str, bool] = {}
        self.prefixes = {t[:k] for t in ids_of for k in range(len(t))}  # proper prefixes of tokens
        self._reset()

    def _reset(self) -> None:
        self.stable: dict[tuple[int, int], bool] = {}
        self.keys: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.moves: list[dict[str, tuple[int, tuple]]] = []
        self.final: list[tuple] = []
        self.made = 0
        self._state(("", ((),), (-1,)))

    def _state(self, key: tuple) -> int:
        at = self.ids.get(key)
        if at is None:
            at = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
            self.final.append(key[1][-1])
        return at

    def merge(self, symbols: str) -> list[int]:
        """Ids by repeated merging of the pair that comes first in order."""
        parts, order = list(symbols), self.order
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                r = order(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, where = r, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return [self.ids_of[p] for p in parts]

    def _is_stable(self, left: int, right: int) -> bool:
        known = self.stable.get((left, right))
        if known is None:
            known = self.merge(self.token_of[left] + self.token_of[right]) == [left, right]
            self.stable[left, right] = known
        return known

    def _is_reachable(self, token: str) -> bool:
        known = self.reachable.get(token)
        if known is None:
            known = self.reachable[token] = self.merge(token) == [self.ids_of[token]]
        return known

    def _step(self, state: int, symbol: str) -> tuple[int, tuple]:
        """Make the transition. A key is (lookahead, pending tokens and last token for each position in it)."""
        seen, pending, last = self.keys[state]
        seen += symbol
        ids_of = self.ids_of
        path, token = None, -1
        for k in range(len(pending)):  # the longest candidate first
            piece = seen[k:]
            t = ids_of.get(piece)
            if t is None or not self._is_reachable(piece):
                continue
            if last[k] < 0 or self._is_stable(last[k], t):
                path, token = (*pending[k], t), t
                break
        if path is None:
            raise ValueError("no token covers a symbol; the vocabulary must hold every single one")
        pending, last = (*pending, path), (*last, token)
        start = 0
        while seen[start:] not in self.prefixes:
            start += 1
        seen, pending, last = seen[start:], pending[start:], last[start:]
        shared = 0
        least = min(map(len, pending))
        first = pending[0]
        while shared < least and all(p[shared] == first[shared] for p in pending):
            shared += 1
        out = first[:shared]
        if shared:
            pending = tuple(p[shared:] for p in pending)
        to = self._state((seen, pending, last))
        self.moves[state][symbol] = (to, out)
        self.made += 1
        return to, out

    def encode(self, piece: str) -> list[int]:
        """Ids of one piece; with `whole`, a piece that is itself a token is that token."""
        if self.whole:
            known = self.ids_of.get(piece)
            if known is not None:
                return [known]
        if self.made > self.most:
            self._reset()
        moves, state, out = self.moves, 0, []
        for symbol in piece:
            move = moves[state].get(symbol)
            if move is None:
                move = self._step(state, symbol)
            state, emitted = move
            if emitted:
                out.extend(emitted)
        out.extend(self.final[state])
        return out


class Codec:
    """Encoder and decoder of whole texts; what it remembers of pieces is bounded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer({t.decode("latin-1"): i for t, i in ranks.items()})
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.table = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.table[i] = t

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = self.find(text)
        memo = self.memo
        try:
            return b"".join(map(memo.__getitem__, pieces))
        except KeyError:
            pass
        if len(memo) > MAX_MEMO:
            memo.clear()
        encode = self.machine.encode
        for p in pieces:
            if p not in memo:
                memo[p] = array("I", encode(p.encode("utf-8", "surrogatepass").decode("latin-1"))).tobytes()
        return b"".join(map(memo.__getitem__, pieces))

    def decode(self, ids: bytes) -> Iterator[str]:
        """Text pieces of the ids, by an incremental UTF-8 machine; ill-formed bytes become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        numbers = array("I", ids)
        table = self.table
        for at in range(0, len(numbers), DECODE_CHUNK):
            yield machine.decode(b"".join(map(table.__getitem__, numbers[at : at + DECODE_CHUNK])))
        yield machine.decode(b"", True)


_codecs: dict[tuple[str, str], Codec] = {}


def worker_codec(path: str, pattern: str) -> Codec:
    """One codec for each rank file and worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        codec = worker_codec(path, pattern)
        for b in pieces(batches):
            ids = [array("I", codec.encode(t or "")).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text): ids decoded as a stream."""

    def run(batches):
        codec = worker_codec(path, pattern)
        for b in pieces(batches):
            texts = ["".join(codec.decode(array("I", i or []).tobytes())) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode each text and decode its ids again, row by row."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        codec = worker_codec(path, pattern)
        for b in pieces(batches):
            counts, ids_sha, text_sha = [], [], []
            for t in b.column(1).to_pylist():
                ids = codec.encode(t or "")
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                h = hashlib.sha256()
                for piece in codec.decode(ids):
                    h.update(piece.encode())
                text_sha.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

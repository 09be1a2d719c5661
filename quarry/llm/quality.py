"""Text quality by a sparse rule ensemble.

Statistics of every whole text (character classes, words, lines, repetition) feed small decision trees grown on
bootstrap samples of labelled rows. Each path from a root to a node is a conjunctive rule; lasso logistic regression
weighs the rules and drops most of them, and what is left is compiled into one Spark column expression over the
statistics, so that scoring is plain arithmetic in the engine.

Fitted on at most `TRAIN_ROWS` labelled rows whose crc32(doc_id as text) mod 5 isn't 0.

Defined results: null and empty texts have all statistics 0 and are scored like any other; without labelled rows of
both kinds the score is the constant share of good rows (0.5 without any).
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import pieces
from quarry.llm.html import STOP_WORDS
from quarry.llm.toxicity import training_rows

TRAIN_ROWS = 10_000
TREES, DEPTH, LEAF = 24, 3, 8
LASSO = 0.0015

STATISTICS = (
    "chars", "words", "word_length", "upper", "digits", "punctuation", "symbols", "marks", "bars", "spaces", "other",
    "distinct_words", "top_word", "repeated_next", "stop_words", "lines", "repeated_lines", "line_length", "odd_ends", "distinct_pairs",
)

_UPPER, _LOWER, _DIGIT, _PUNCT, _SYMBOL, _MARK, _BAR, _SPACE, _OTHER = range(9)


def _classes() -> np.ndarray:
    """A class for each code point, by its general category."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for i in range(0x30000):
        c = chr(i)
        k = unicodedata.category(c)
        out[i] = (
            _SYMBOL if c in "*#$%&@^~=+<>{}[]\\/_" else _MARK if c in "!?" else _BAR if c == "|" else _SPACE if c.isspace() else _UPPER if k == "Lu"
            else _LOWER if k[0] == "L" else _DIGIT if k[0] == "N" else _PUNCT if k[0] == "P" else _SYMBOL if k[0] == "S" else _OTHER
        )
    return out


_class_of: list[np.ndarray] = []


def statistics(text: str) -> list[float]:
    """The values of STATISTICS for a text."""
    if not text:
        return [0.0] * len(STATISTICS)
    if not _class_of:
        _class_of.append(_classes())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    k = np.bincount(_class_of[0][codes], minlength=9) / n
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    top = max(counts.values(), default=0)
    lower = [w.lower().strip(".,;:!?") for w in counts]
    stops = sum(c for w, c in zip(lower, counts.values(), strict=True) if w in STOP_WORDS)
    repeated = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum(x.rstrip()[-1] not in ".!?:;,\"')" for x in lines)
    letters = k[_UPPER] + k[_LOWER]
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), (n - k[_SPACE] * n) / m, k[_UPPER] / letters if letters else 0.0, k[_DIGIT], k[_PUNCT], k[_SYMBOL], k[_MARK], k[_BAR], k[_SPACE], k[_OTHER],
        len(counts) / m, top / m, repeated / m, stops / m, float(np.log1p(len(lines))), 1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), ends / max(1, len(lines)), pairs / max(1, len(words) - 1),
    ]


def with_statistics(df: DataFrame, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The `carry` columns with a double column for each statistic; no shuffle."""
    rows = df.select(*carry, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    names = [f"s_{s}" for s in STATISTICS]

    def run(batches):
        for b in pieces(batches):
            found = np.array([statistics(t or "") for t in b.column(len(carry)).to_pylist()], float).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(carry))), *(pa.array(found[:, j]) for j in range(len(names)))], [*carry, *names])

    return rows.mapInArrow(run, ", ".join([schema, *(f"{x} double" for x in names)]))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, threshold), sorted


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH, path: Rule = ()) -> list[Rule]:
    """Rules of a small tree: the path to every node below the root."""
    rules = [tuple(sorted(path))] if path else []
    if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
        return rules
    best = (1e-9, -1, 0.0)
    base = y.mean() * (1 - y.mean()) * len(y)
    for j in rng.choice(x.shape[1], max(4, x.shape[1] // 2), replace=False):
        order = np.argsort(x[:, j], kind="stable")
        v, c = x[order, j], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        cut = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= LEAF) & (len(y) - n[:-1] >= LEAF))
        if not len(cut):
            continue
        a, left = c[cut] / n[cut], n[cut]
        right = len(y) - left
        b = (c[-1] - c[cut]) / right
        gain = base - left * a * (1 - a) - right * b * (1 - b)
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (float(gain[i]), int(j), float((v[cut[i]] + v[cut[i] + 1]) / 2))
    _, j, t = best
    if j < 0:
        return rules
    above = x[:, j] > t
    return rules + grow(x[above], y[above], rng, depth - 1, (*path, (j, True, t))) + grow(x[~above], y[~above], rng, depth - 1, (*path, (j, False, t)))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, t in rule:
        out &= (x[:, j] > t) == above
    return out


@dataclass
class Model:
    """Weighted rules and an intercept."""

    rules: list[tuple[Rule, float]] = field(default_factory=list)
    intercept: float = 0.0

    def column(self) -> Column:
        """The score as a Spark expression over the statistics' columns."""
        z = F.lit(self.intercept)
        for rule, w in self.rules:
            test = F.lit(True)
            for j, above, t in rule:
                c = F.col(f"s_{STATISTICS[j]}")
                test = test & ((c > t) if above else (c <= t))
            z = z + F.when(test, w).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = LASSO, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient steps."""
    n, m = r.shape
    step = 4.0 / (np.linalg.norm(r, 2) ** 2 / n + 1)
    w = v = np.zeros(m)
    b = c = float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    t = 1.0
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-np.clip(r @ v + c, -30, 30))) - y) / n
        new = v - step * (r.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = c - step * float(g.sum())
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / s * (new - w), nb + (t - 1) / s * (nb - b)
        w, b, t = new, nb, s
    return w, b


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """A model from statistics and labels."""
    if not len(y):
        return Model()
    if y.min() == y.max():
        return Model(intercept=4.0 if y[0] else -4.0)
    rng = np.random.default_rng(seed)
    rules: dict[Rule, None] = {}
    few, many = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    for _ in range(TREES):
        pick = np.concatenate([rng.choice(few, min(len(few), 1000)), rng.choice(many, min(len(many), 2000))])
        rules.update(dict.fromkeys(grow(x[pick], y[pick], rng)))
    distinct: dict[bytes, Rule] = {}
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        h = holds(rule, x)
        if LEAF <= h.sum() <= len(y) - LEAF:
            distinct.setdefault(np.packbits(h).tobytes(), rule)
    kept = list(distinct.values())
    if not kept:
        return Model(intercept=float(np.log(y.mean() / (1 - y.mean()))))
    r = np.array([holds(rule, x) for rule in kept], float).T
    w, b = lasso(r, y)
    return Model([(rule, float(a)) for rule, a in zip(kept, w, strict=True) if abs(a) > 1e-6], b)


def fit_tables(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """A model from the statistics of at most `limit` labelled rows; only those numbers are sent to the driver."""
    rows = with_statistics(training_rows(docs, labels, limit, "quality"), ("doc_id", "y"))
    found = sorted(tuple(r) for r in rows.collect())
    data = np.array([r[2:] for r in found], float).reshape(-1, len(STATISTICS))
    return fit(data, np.array([r[1] for r in found], float))


def score(df: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The `carry` columns, the statistics and the score of every whole text."""
    return with_statistics(df, carry, text_col).withColumn("score", model.column())

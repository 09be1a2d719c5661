"""Toxicity by a weighted finite-state pattern grammar.

Words become classes: insult, suspect, threat, target, negation, reported speech, other. Weighted transducers rewrite the
classes of a clause: one marks what stands in the reach of a negation, one what follows a verb of saying, one what is
aimed at someone anywhere in the clause (it guesses at the start and accepts only if the guess proves right). Their
composition, built lazily, reads the clause once and writes, for every insult or threat, the context it stands in: plain,
at a target, negated, or reported. A document's score is a logistic function of the weighted matches of its clauses, so
a negated or quoted insult counts for what the labelled rows say such a match is worth.

The insult lexicon is learned: stems (word beginnings) that occur in labelled toxic documents and next to never in the
others, beside a short fixed list. Stems of which several words in one text tell toxic documents, while a single one
does not, are suspects. All is fitted on a bounded sample (`TRAIN_ROWS`) of labelled rows whose crc32(doc_id as text) mod 5
isn't 0; of near copies with the same label in the sample one counts. Texts stay on the executors: the driver gets counts of stems that
several toxic documents share, and a row of numbers for each labelled row. Scoring covers every row and whole texts.

Defined results: null and empty texts match nothing and get the base score; without any labelled row, or with labels of
one kind only, the fixed list with fixed weights scores; rows without an id are never labelled; repeated rows give
repeated results.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import pieces
from quarry.session import materialize

TRAIN_ROWS = 10_000
FOLDS, HELD_OUT = 5, 0
MIN_DOCS, MIN_PRECISION, SUSPECT_PRECISION = 3, 0.95, 0.75
FALSE_STEMS = 0.5  # stems that chance alone may bring in
NEAR_COPY = 8  # lowest word hashes that near copies share
STEM_LENGTHS = range(3, 13)

# Word lists.
INSULTS = frozenset("idiot moron scum loser bastard dumbass imbecile dimwit cretin halfwit vermin".split())
THREATS = frozenset("kill murder strangle stab shoot slaughter behead lynch töten umbringen tuer matar".split())
TARGETS = frozenset("you your yours yourself he him she her they them du dich dir ihr euch tu te toi vous tú ti vosotros ustedes".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't don't nicht kein keine nie ne pas jamais nunca ni".split())
REPORTS = frozenset("said says wrote writes called calls quoted quotes claims claimed alleged sagte schrieb dit écrit dijo escribió".split())

CONTEXTS = ("insult", "insult at target", "insult negated", "insult reported", "threat", "threat at target", "threat negated", "threat reported", "suspect", "several suspects")
FALLBACK = {"insult": 4.0, "insult at target": 5.0, "insult negated": 1.0, "insult reported": 2.0, "threat": 1.0, "threat at target": 4.0, "threat negated": 0.3, "threat reported": 0.5, "suspect": 0.5, "several suspects": 1.0}
NEGATION_REACH = 3
WORTH = frozenset(CONTEXTS)

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:\n]")
_WORD = re.compile(r"[^\W_]+")


# --- weighted transducers over word classes ---------------------------------------------------------------------


class Transducer:
    """States, and arcs (state, symbol) -> (state, symbol written, weight); a missing arc ends the path.

    Arcs are made by a rule when they are first asked for, and kept. Several start states are guesses, of which those
    that end in a final state count.
    """

    def __init__(self, starts: tuple, arc: Callable[[object, str], tuple[object, str, float] | None], final: Callable[[object], bool] = lambda state: True):
        self.starts, self.arc, self.final, self.arcs = starts, arc, final, {}

    def step(self, state, symbol: str) -> tuple[object, str, float] | None:
        key = (state, symbol)
        if key not in self.arcs:
            self.arcs[key] = self.arc(state, symbol)
        return self.arcs[key]

    def then(self, other: Transducer) -> Transducer:
        """The composition: `other` reads what this one writes; weights multiply."""

        def arc(state, symbol):
            first = self.step(state[0], symbol)
            second = first and other.step(state[1], first[1])
            return second and ((first[0], second[0]), second[1], first[2] * second[2])

        return Transducer(tuple((a, b) for a in self.starts for b in other.starts), arc, lambda state: self.final(state[0]) and other.final(state[1]))

    def read(self, symbols: list[tuple[str, float]]) -> list[tuple[str, float]]:
        """What the first accepting path writes for (symbol, weight) pairs."""
        for state in self.starts:
            out = []
            for symbol, weight in symbols:
                move = self.step(state, symbol)
                if move is None:
                    break
                state = move[0]
                out.append((move[1], weight * move[2]))
            else:
                if self.final(state):
                    return out
        return []


MARKED = frozenset(("insult", "threat"))


def negation_machine() -> Transducer:
    """State: words for which a negation still holds."""

    def arc(state, symbol):
        if symbol == "negation":
            return NEGATION_REACH, symbol, 1.0
        return max(0, state - 1), f"{symbol} negated" if state and symbol in MARKED else symbol, 1.0

    return Transducer((0,), arc)


def report_machine() -> Transducer:
    """State: 1 from a verb of saying to the clause's end. What is negated stays so."""

    def arc(state, symbol):
        return 1 if symbol == "report" else state, f"{symbol} reported" if state and symbol in MARKED else symbol, 1.0

    return Transducer((0,), arc)


def target_machine() -> Transducer:
    """Starts with a guess: no word for a person in the clause, or one to come ("due"), which then is "met"."""

    def arc(state, symbol):
        if symbol == "target":
            return None if state == "none" else ("met", symbol, 1.0)
        return state, f"{symbol} at target" if state != "none" and symbol in MARKED else symbol, 1.0

    return Transducer(("none", "due"), arc, lambda state: state != "due")


class Grammar:
    """The composition of the three machines, read for one clause at a time."""

    def __init__(self):
        self.machine = negation_machine().then(report_machine()).then(target_machine())

    def clause(self, kinds: list[tuple[str, float]]) -> list[tuple[str, float]]:
        """(context, weight) of each insult, threat or suspect in the clause."""
        return [(symbol, weight) for symbol, weight in self.machine.read(kinds) if symbol in WORTH]


@dataclass
class Model:
    """Stem weights, context weights and intercept."""

    stems: dict[str, float] = field(default_factory=lambda: {w: 1.0 for w in INSULTS})
    weights: dict[str, float] = field(default_factory=lambda: dict(FALLBACK))
    intercept: float = -3.0

    def finder(self) -> re.Pattern:
        """Finds the beginning of any stem or threat at a word's start, in one pass."""
        return re.compile(rf"(?<![^\W_])(?:{_trie_pattern([*self.stems, *THREATS])})")


def _trie_pattern(words: list[str]) -> str:
    trie: dict = {}
    for w in words:
        node = trie
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def write(node: dict) -> str:
        if "" in node:
            return ""  # a stem: longer words that begin with it match too
        parts = [re.escape(c) + write(n) for c, n in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return write(trie) or "(?!)"


class Scorer:
    """Matches and scores texts under a model."""

    def __init__(self, model: Model):
        self.model, self.find, self.grammar = model, model.finder().search, Grammar()
        self.lengths = sorted({len(s) for s in model.stems})
        self.kinds: dict[str, tuple[str, float]] = {}

    def kind_of(self, word: str) -> tuple[str, float]:
        known = self.kinds.get(word)
        if known is None:
            known = ("other", 0.0)
            best = max((self.model.stems[word[:n]] for n in self.lengths if n <= len(word) and word[:n] in self.model.stems), default=None)
            if best is not None:
                known = ("insult" if best > 0 else "suspect", abs(best))
            else:
                for name, words in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)):
                    if word in words:
                        known = (name, 1.0)
                        break
            if len(self.kinds) > 50_000:
                self.kinds.clear()
            self.kinds[word] = known
        return known

    def matches(self, text: str) -> dict[str, float]:
        """Summed weights by context over the clauses of the whole text."""
        text = text.lower()
        total: dict[str, float] = {}
        if not self.find(text):
            return total
        clause: list[tuple[str, float]] = []
        hit = False
        for token in [*_TOKEN.findall(text), "."]:
            if token in ".!?;:\n":
                if hit:
                    for context, w in self.grammar.clause(clause):
                        total[context] = total.get(context, 0.0) + w
                clause, hit = [], False
            else:
                kind = self.kind_of(token)
                hit |= kind[0] in ("insult", "threat", "suspect")
                clause.append(kind)
        if total.get("suspect", 0.0) > 1:
            total["several suspects"] = total["suspect"] - 1
        return total

    def score(self, matches: dict[str, float]) -> float:
        z = self.model.intercept + sum(self.model.weights[c] * math.log1p(w) for c, w in matches.items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


# --- fitting --------------------------------------------------------------------------------------------------------


def _stem_counts(text: str, known: frozenset[str] | None = None) -> Counter:
    """How many different words of the text begin with each stem (of `known`, if given)."""
    found: Counter = Counter()
    for w in set(_WORD.findall(text.lower())):
        found.update(w[:k] for k in STEM_LENGTHS if k <= len(w) and (known is None or w[:k] in known))
    return found


def stem_documents(rows: DataFrame, known: frozenset[str] | None = None) -> DataFrame:
    """(stem, one, several): in how many of the rows' texts a word begins with the stem, and in how many several do.

    Tasks count on their own first.
    """

    def run(batches):
        one, several = Counter(), Counter()
        for b in pieces(batches):
            for text in b.column(0).to_pylist():
                counts = _stem_counts(text or "", known)
                one.update(counts.keys())
                several.update(s for s, n in counts.items() if n > 1)
        yield pa.RecordBatch.from_arrays([pa.array(list(one), pa.string()), pa.array(list(one.values()), pa.int64()), pa.array([several[s] for s in one], pa.int64())], ["stem", "one", "several"])

    parts = rows.select("text").mapInArrow(run, "stem string, one long, several long")
    return parts.groupBy("stem").agg(F.sum("one").alias("one"), F.sum("several").alias("several"))


def least_documents(stems: int, toxic: int, rows: int) -> int:
    """Toxic documents that a stem needs so that, of so many stems, chance puts FALSE_STEMS into that many toxic and no other documents."""
    return max(MIN_DOCS, math.ceil(math.log(max(stems, 1) / FALSE_STEMS) / math.log(rows / toxic)))


def chosen_stems(positive: dict[str, int], negative: dict[str, int], precision: float, least: int) -> dict[str, float]:
    """Stems of `least` toxic documents to their smoothed share of those, where it reaches `precision`.

    Of stems that begin each other the shortest is taken, and lengthened while it loses next to nothing.
    """
    share = lambda s: positive[s] / (positive[s] + negative.get(s, 0) + 0.25)
    good = {s: n for s, n in positive.items() if n >= least and share(s) >= precision}
    children: dict[str, list[str]] = {}
    for s in good:
        children.setdefault(s[:-1], []).append(s)
    stems: dict[str, float] = {}
    for s in sorted(good, key=lambda s: (len(s), s)):
        if any(s[:k] in good for k in range(min(STEM_LENGTHS), len(s))):
            continue
        at = s
        while longer := [c for c in children.get(at, ()) if good[c] >= 0.98 * good[at]]:
            at = max(longer, key=lambda c: (good[c], c))
        stems[at] = share(at)
    return stems


def _one_of_near_copies(rows: DataFrame) -> DataFrame:
    """(text, y) without repeats: of rows of one label whose lowest hashes of words agree, and that have as many words up to a fifth, the least by id stays."""

    def run(batches):
        for b in pieces(batches):
            keys = []
            for text in b.column(1).to_pylist():
                words = set((text or "").lower().split())
                low = sorted(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words)[:NEAR_COPY]
                keys.append(f"{len(words).bit_length()}:{low}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.string())], ["doc_id", "text", "y", "key"])

    keyed = rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, text string, y int, key string")
    return keyed.groupBy("y", "key").agg(F.min(F.struct("doc_id", "text")).alias("first")).select("first.text", "y")


def learn_stems(rows: DataFrame) -> dict[str, float]:
    """Sure stems with positive weights, suspects with negative. Of a sure stem that is a rarer form of a suspect, the suspect stays."""
    toxic, clean = rows.where("y = 1"), rows.where("y = 0")
    n_toxic, n = toxic.count(), rows.count()
    counts = {r.stem: (r.one, r.several) for r in stem_documents(toxic).where(F.col("one") >= MIN_DOCS).collect()}
    others = {r.stem: (r.one, r.several) for r in stem_documents(clean, frozenset(counts)).collect()}
    least = least_documents(len(counts), n_toxic, n)
    of = lambda table, k: {s: x[k] for s, x in table.items()}
    sure = chosen_stems(of(counts, 0), of(others, 0), MIN_PRECISION, least)
    suspects = chosen_stems(of(counts, 1), of(others, 1), SUSPECT_PRECISION, least)
    suspects = {s: w for s, w in suspects.items() if not any(s[:k] in sure for k in range(1, len(s) + 1))}
    rarer = lambda s: any(s[:k] in suspects and 2 * counts[s][0] < counts[s[:k]][1] for k in range(1, len(s)))
    return {s: -w for s, w in suspects.items()} | {s: w for s, w in sure.items() if not rarer(s)} | {w: 1.0 for w in INSULTS}


def match_rows(rows: DataFrame, model: Model) -> np.ndarray:
    """(label, log1p of the matches by context) of each row: numbers only."""

    def run(batches):
        scorer = Scorer(model)
        for b in pieces(batches):
            x = np.zeros((b.num_rows, len(CONTEXTS)))
            for i, text in enumerate(b.column(0).to_pylist()):
                for c, w in scorer.matches(text or "").items():
                    x[i, CONTEXTS.index(c)] = math.log1p(w)
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(x[:, j]) for j in range(len(CONTEXTS)))], ["y", *(f"c{j}" for j in range(len(CONTEXTS)))])

    found = rows.select("text", "y").mapInArrow(run, "y int, " + ", ".join(f"c{j} double" for j in range(len(CONTEXTS))))
    return np.array(sorted(tuple(r) for r in found.collect()), float).reshape(-1, 1 + len(CONTEXTS))


def weigh(data: np.ndarray) -> tuple[dict[str, float], float]:
    """Context weights and intercept: logistic loss with a pull to the prior, by Newton steps; weights not below 0."""
    y, x = data[:, 0], np.c_[data[:, 1:], np.ones(len(data))]
    prior = np.array([*(FALLBACK[c] for c in CONTEXTS), -3.0])
    beta, pull = prior.copy(), np.array([0.2] * len(CONTEXTS) + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (p - y) + pull * (beta - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-6)
        beta = beta - np.clip(np.linalg.solve(curve, slope), -1, 1)
        beta[:-1] = np.maximum(0, beta[:-1])
        for aimed in ("insult at target", "threat at target"):  # no less than the same words aimed at nobody
            i = CONTEXTS.index(aimed)
            beta[i] = max(beta[i], beta[CONTEXTS.index(aimed.split()[0])])
    return dict(zip(CONTEXTS, map(float, beta[:-1]), strict=True)), float(beta[-1])


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, label: str = "toxic") -> DataFrame:
    """(text, y) of at most `limit` labelled rows outside the held-out fold, chosen by a hash of the id."""
    key = F.col("doc_id").cast("long")
    chosen = (
        labels.select(key.alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (held_out_fold("doc_id") != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    texts = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")


def held_out_fold(column: str):
    """crc32(doc_id as text) mod 5."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def fit_tables(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """A model from at most `limit` labelled rows."""
    rows = materialize(_one_of_near_copies(training_rows(docs, labels, limit)), "labelled")
    if rows.select("y").distinct().count() < 2:
        return Model()
    stems = learn_stems(rows)
    return Model(stems, *weigh(match_rows(rows, Model(stems))))


def score(df: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The `carry` columns with score (double) and matches (string) of every whole text, without a shuffle."""
    rows = df.select(*carry, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")

    def run(batches):
        scorer = Scorer(model)
        for b in pieces(batches):
            found = [scorer.matches(t or "") for t in b.column(len(carry)).to_pylist()]
            said = ["; ".join(f"{c}: {m[c]:.3f}" for c in CONTEXTS if c in m) for m in found]
            columns = [b.column(i) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([scorer.score(m) for m in found], pa.float64()), pa.array(said, pa.string())], [*carry, "score", "matches"])

    return rows.mapInArrow(run, f"{schema}, score double, matches string")

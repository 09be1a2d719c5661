"""Personal data by weak supervision, in DataFrame functions alone.

Candidates are all matches of four base patterns (email, ip, card, phone) and of looser patterns for the same kinds
(spelled-out addresses, national numbers, other separators). Five labelers, each looking at something else, vote on every
candidate for, against or not at all: whether it stands free of what is around it, a structure test (checksum, ranges,
digit counts), a gazetteer (domain endings, card and country prefixes, reserved addresses), words of the context that
speak for the kind, and words that speak for something else. Expectation-maximisation over the table of vote patterns
estimates how reliable each labeler is and how likely each pattern is personal data. Those likelihoods train the final
classifier, a logistic function of the span itself (how many digits, which separators) and of the votes, of which the
weights are put into a column expression.

Valid base matches are always spans. Looser candidates become spans where the classifier says so and no base span
covers them.

Texts are searched once: the candidates are written to the shared folder, and both training and spans read them there.
Only the table of vote patterns and span features (at most 4 * 3^5 * 16 rows) is sent to the driver. Every step on rows is
an expression over one row, so nothing is shuffled but those counts.

Defined results: null and empty texts have no spans; positions are code points, ends exclusive; repeated rows give
repeated results; without candidates nothing is trained and the base spans are the result; where spans of different kinds overlap,
redaction masks the one that begins first, of those the shortest, and what the others have beyond it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import materialize

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("free", "structure", "gazetteer", "context", "elsewhere")
DIGITS, SEPARATORS = 4, 4  # kinds of spans by number of digits and by what stands between them
CONTEXT = 40
ACCEPT = 0.5

# Base patterns. Possessive repeats and look-behinds match the same spans in linear time.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}(?: ?(?:\(at\)|\[at\]|\{{at\}}|@) ?[A-Za-z0-9-]{{1,63}}(?: ?(?:\(dot\)|\[dot\]|\{{dot\}}) ?[A-Za-z0-9-]{{1,63}}| dot [A-Za-z0-9-]{{1,63}}|\.[A-Za-z0-9-]{{1,63}}){{1,5}}| at [A-Za-z0-9-]{{1,63}}(?: dot [A-Za-z0-9-]{{1,63}}){{1,5}})",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_]|[ -]{1,3})[0-9]{4}(?:[./_]|[ -]{1,3})[0-9]{4}(?:[./_]|[ -]{1,3})[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+.])(?:00[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,5}\) ?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9.])",
}
# A cheap test whether a text can hold a match at all.
HINTS = {"email": r"@|[\(\[\{]at[\)\]\}]| at [A-Za-z0-9-]{1,63} dot ", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]|[0-9]{3}\)? ?[ .-]?[0-9]{3}"}
BASE_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
ENDINGS = "com|org|net|edu|gov|mil|int|io|co|info|biz|me|dev|app|de|fr|es|uk|eu|us|ca|it|nl|ch|at|be|pt|pl|se|no|dk|fi|ie|mx|ar|br|jp|cn|in|au|nz|kr|ru"
SPEAKS_FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|kontakt|contacto|courriel|correo|write|reach|address|reply)\b",
    "ip": r"(?i)\b(?:ip|ipv[46]|host|server|client|address|adresse|from|login|gateway|node)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment|pan)\b",
    "phone": r"(?i)\b(?:phone|tel|telefon|téléphone|teléfono|call|mobile|cell|fax|ring|sms|whatsapp|contact)\b",
}
SPEAKS_AGAINST = {
    "email": r"(?i)\b(?:git|ssh|rsync|scp)\b",
    "ip": r"(?i)\b(?:version|ver|release|v|section|chapter|build|rev)\b\W*$",
    "card": r"(?i)\b(?:isbn|order|invoice|serial|tracking|sku|id|ref|timestamp|hash)\b",
    "phone": r"(?i)\b(?:isbn|order|invoice|serial|tracking|sku|id|ref|version|hash)\b",
}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """Whether the digits of `c` pass the checksum."""
    d = _digits(c)
    backwards = F.reverse(d)

    def value(i: Column) -> Column:
        v = F.substring(backwards, i, F.lit(1)).cast("int") * (1 + (i + 1) % 2)
        return F.when(v > 9, v - 9).otherwise(v)

    values = F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), value)
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x.cast("int"), F.lit(0))) % 10 == 0


def _structure(kind: str, c: Column) -> Column:
    """The base test of a match."""
    n = F.length(_digits(c))
    if kind == "ip":
        return c.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$") | c.contains(":")
    if kind == "card":
        return n.between(13, 19) & luhn(c)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _span_kind(c: Column) -> Column:
    """A number for the span's digits (few, of a phone, of a card, more) and separators (none, spaces, signs, both)."""
    n = F.length(_digits(c))
    digits = F.when(n < 9, 0).when(n < 13, 1).when(n <= 19, 2).otherwise(3)
    return digits * SEPARATORS + c.contains(" ").cast("int") + 2 * c.rlike("[-._/()]").cast("int")


def _gazetteer(kind: str, c: Column) -> Column:
    if kind == "email":
        return F.when(c.rlike(rf"(?i)(?:\.|dot[\)\]\}}]? )(?:{ENDINGS})$"), 1).otherwise(-1)
    if kind == "ip":
        return F.when(c.rlike(r"^(?:0|127|255)\."), -1).when(c.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\."), 1).otherwise(0)
    if kind == "card":
        return F.when(_digits(c).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"), 1).otherwise(-1)
    return F.when(c.rlike(r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"), 1).otherwise(0)


def _found(text: Column, pattern: str, hint: str, group: int) -> Column:
    """All values of a group of (gap)(match) over the text; group 1 is what lies before each match, 2 the match.

    Anchored to the end of the match before, so that the rest behind the last match is read once.
    """
    return F.when(text.rlike(hint), F.regexp_extract_all(text, F.lit(rf"\G(?s)(.*?)({pattern})"), F.lit(group))).otherwise(F.array().cast("array<string>"))


def _candidates(text: Column, gaps: Column, hits: Column, kind: str, base: bool) -> Column:
    """Structs of kind, start, end, base, loose, span and the votes, for each match of one pattern."""
    lengths = F.zip_with(gaps, hits, lambda g, h: (F.length(g) + F.length(h)).cast("long"))
    ends = F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def vote(test: Column, yes: int, no: int) -> Column:
        return F.when(test, yes).otherwise(no).cast("int")

    def candidate(h: Column, i: Column) -> Column:
        end = F.get(ends, i + 1)
        start = end - F.length(h)
        before = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)).cast("int") + 1, F.least(start, F.lit(CONTEXT).cast("long")).cast("int"))
        valid = _structure(kind, h)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            start.alias("start"),
            end.alias("end"),
            (valid if base else F.lit(False)).alias("base"),
            F.lit(not base).alias("loose"),
            _span_kind(h).alias("span"),
            F.array(
                vote(F.right(before, F.lit(1)).rlike(r"[\p{L}\p{N}_@#/\\=]") | F.substring(text, (end + 1).cast("int"), F.lit(1)).rlike(r"[\p{L}\p{N}_@#/\\=]"), -1, 1),
                vote(valid, 1, -1),
                _gazetteer(kind, h).cast("int"),
                vote(before.rlike(SPEAKS_FOR[kind]), 1, 0),
                vote(before.rlike(SPEAKS_AGAINST[kind]), -1, 0),
            ).alias("votes"),
        )

    return F.transform(hits, candidate)


def with_candidates(df: DataFrame, text_col: str = "text", name: str = "candidates") -> DataFrame:
    """`df` with an array of candidates; looser ones that overlap a valid base span of any kind are left out."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = df.withColumn("_pii_text", text)
    parts = []
    for kind in KINDS:
        for base, patterns, hints in ((True, BASE, BASE_HINTS), (False, LOOSE, HINTS)):
            parts.append((kind, base, f"_pii_{kind}_{'base' if base else 'loose'}"))
            p = parts[-1][2]
            out = out.withColumns({f"{p}_g": _found(F.col("_pii_text"), patterns[kind], hints[kind], 1), f"{p}_h": _found(F.col("_pii_text"), patterns[kind], hints[kind], 2)})
    out = out.withColumns({p: _candidates(F.col("_pii_text"), F.col(f"{p}_g"), F.col(f"{p}_h"), kind, base) for kind, base, p in parts})
    sure = F.concat(*(p for _, base, p in parts if base))
    loose = F.concat(*(p for _, base, p in parts if not base))
    out = out.withColumns({"_pii_sure": sure, "_pii_loose": loose})
    free = F.filter("_pii_loose", lambda x: ~F.exists("_pii_sure", lambda b: b["base"] & (x["start"] < b["end"]) & (b["start"] < x["end"])))
    return out.withColumn(name, F.concat("_pii_sure", free)).select(*df.columns, name)


@dataclass
class Model:
    """Weights of the spans' kinds and of the votes by kind of data, with what was estimated on the way."""

    weights: dict[int, tuple[list[float], list[float]]] = field(default_factory=dict)  # kind: kinds of spans (with the intercept), labelers
    reliability: dict[int, list[float]] = field(default_factory=dict)

    def accepts(self, candidate: Column) -> Column:
        """Whether the classifier takes a candidate for personal data."""
        out = F.lit(False)
        for kind, (spans, w) in sorted(self.weights.items()):
            z = F.get(F.array(*map(F.lit, spans)), candidate["span"])
            for j, weight in enumerate(w):
                z = z + F.get(candidate["votes"], F.lit(j)) * F.lit(weight)
            out = F.when(candidate["kind"] == kind, 1 / (1 + F.exp(-z)) >= ACCEPT).otherwise(out)
        return out


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """For vote patterns and their counts: the likelihood of each, each labeler's reliability, and the prior.

    Starts from the majority vote. Reliabilities have a weak prior in favour of labelers, so that a labeler that hardly
    ever votes is not trusted or damned on little.
    """
    p = 1 / (1 + np.exp(-votes.sum(axis=1).astype(float)))
    right, prior = np.full(votes.shape[1], 0.7), 0.5
    for _ in range(rounds):
        prior = float(np.clip((counts @ p + 2) / (counts.sum() + 4), 0.02, 0.98))
        agree = ((votes == 1) * p[:, None] + (votes == -1) * (1 - p)[:, None]) * counts[:, None]
        cast = (votes != 0) * counts[:, None]
        right = np.clip((agree.sum(axis=0) + 7) / (cast.sum(axis=0) + 10), 0.5, 0.995)
        z = np.log(prior / (1 - prior)) + votes @ np.log(right / (1 - right))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, right, prior


def train(table: list[tuple[int, int, list[int], int]]) -> Model:
    """A model from (kind, span, votes, count) rows."""
    model = Model()
    for kind in range(len(KINDS)):
        rows = sorted((v, k, n) for own, k, v, n in table if own == kind)
        if not rows:
            continue
        votes, kinds, counts = np.array([v for v, _, _ in rows], float), np.array([k for _, k, _ in rows]), np.array([n for _, _, n in rows], float)
        p, right, _ = expectation_maximisation(votes, counts)
        digits, separators = kinds // SEPARATORS, kinds % SEPARATORS
        x = np.c_[np.ones(len(votes)), np.eye(DIGITS)[digits], np.eye(SEPARATORS)[separators], votes]
        w = np.zeros(x.shape[1])
        share = counts / counts.sum()
        for _ in range(50):  # Newton steps for logistic regression on the likelihoods, weighted by counts
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (share * (q - p)) + 1e-3 * w
            h = (x * (share * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(len(w))
            step = np.linalg.solve(h, g)
            w = w - np.clip(step, -2, 2)
        every = np.arange(DIGITS * SEPARATORS)
        spans = w[0] + w[1 : 1 + DIGITS][every // SEPARATORS] + w[1 + DIGITS : 1 + DIGITS + SEPARATORS][every % SEPARATORS]
        model.weights[kind] = ([float(a) for a in spans], [float(a) for a in w[1 + DIGITS + SEPARATORS :]])
        model.reliability[kind] = [float(r) for r in right]
    return model


def fit(candidates: DataFrame, name: str = "candidates") -> Model:
    """A model from a table with candidates; only the counts of vote patterns and spans reach the driver."""
    exploded = candidates.select(F.explode(name).alias("c")).select("c.kind", "c.span", "c.votes")
    return train([(r["kind"], r["span"], list(r["votes"]), r["n"]) for r in exploded.groupBy("kind", "span", "votes").agg(F.count("*").alias("n")).collect()])


def spans(candidates: DataFrame, model: Model, name: str = "candidates") -> DataFrame:
    """The table with `base_spans` and `all_spans`, arrays of (kind, start, end) sorted by kind and start."""
    bare = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter(name, lambda x: x["base"]), bare))
    taken = F.array_sort(F.transform(F.filter(name, lambda x: x["base"] | (x["loose"] & model.accepts(x))), bare))
    return candidates.withColumns({"base_spans": base, "all_spans": taken}).drop(name)


def _joined(column: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of base spans by kind, their digest and all spans as text."""
    found = materialize(with_candidates(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "candidates"), "candidates")
    done = spans(found, fit(found))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    return done.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("all_spans").alias("spans"))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with each span of the text replaced by its kind in brackets; overlapping spans become one."""
    found = materialize(with_candidates(df, text_col, "_pii_candidates"), "candidates")
    done = spans(found, fit(found, "_pii_candidates"), "_pii_candidates")
    # Spans by position; each keeps what no earlier span has covered.
    placed = F.array_sort(F.transform("all_spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(state: Column, x: Column) -> Column:
        gap = F.substring(F.col(text_col), state["at"].cast("int") + 1, F.greatest(x["start"] - state["at"], F.lit(0)).cast("int"))
        mark = F.when(x["start"] >= state["at"], F.get(names, x["kind"])).otherwise("")
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.concat(state["parts"], F.array(gap, mark)).alias("parts"))

    def finish(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substring(F.col(text_col), state["at"].cast("int") + 1, F.greatest(F.length(text_col) - state["at"], F.lit(0)).cast("int")))

    cleaned = F.when(F.size("all_spans") > 0, F.aggregate(placed, empty, add, finish)).otherwise(F.col(text_col))
    return done.withColumn(text_col, cleaned).select(*df.columns)

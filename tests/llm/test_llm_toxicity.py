"""The grammar against a plain reading of its rules, learning by held-out rows, and odd tables."""

import os
import random
import re
import zlib

import pytest

from quarry.llm import toxicity
from quarry.session import spread, table

SF = "/root/testdata/sf0.1"
STEMS = {"blerg": 0.9, "idiot": 1.0, "glump": -0.8}
LEXICON = ["blergos", "idiots", "glumpy", "kill", "you", "not", "said", "house", "tree", "warm", "Über", "blergen"]


def plain_matches(text):
    """The rules word by word, without machines."""
    total = {}
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        words = re.findall(r"[^\W_]+(?:['’][^\W_]+)*", clause)
        aimed = any(w in toxicity.TARGETS for w in words)
        for k, w in enumerate(words):
            weight = max((abs(v) for s, v in STEMS.items() if w.startswith(s)), default=None)
            kind = next(("insult" if v > 0 else "suspect" for s, v in STEMS.items() if w.startswith(s)), "threat" if w in toxicity.THREATS else None)
            if kind is None:
                continue
            before = words[max(0, k - toxicity.NEGATION_REACH) : k]
            context = kind
            if kind != "suspect":
                if any(x in toxicity.NEGATIONS for x in before):
                    context = f"{kind} negated"
                elif any(x in toxicity.REPORTS for x in words[:k]):
                    context = f"{kind} reported"
                elif aimed:
                    context = f"{kind} at target"
            total[context] = total.get(context, 0.0) + (1.0 if weight is None else weight)
    if total.get("suspect", 0) > 1:
        total["several suspects"] = total["suspect"] - 1
    return total


def test_matches_equal_a_plain_reading():
    scorer, rng = toxicity.Scorer(toxicity.Model(STEMS)), random.Random(3)
    for _ in range(3000):
        text = " ".join(rng.choice(LEXICON) + rng.choice(["", "", "", ".", ";", "\n", ","]) for _ in range(rng.randrange(20)))
        got, want = scorer.matches(text), plain_matches(text)
        assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want), text


def test_machines_compose_with_weights():
    double = toxicity.Transducer((0,), lambda state, symbol: (state + 1, symbol.upper(), 2.0) if state < 2 else None)
    tail = toxicity.Transducer((0, 1), lambda state, symbol: (state, symbol + str(state), 3.0), lambda state: state == 1)
    both = double.then(tail)
    assert both.read([("a", 1.0), ("b", 0.5)]) == [("A1", 6.0), ("B1", 3.0)]
    assert both.read([("a", 1.0)] * 3) == []


def test_chance_sets_how_many_documents_a_stem_needs():
    assert toxicity.least_documents(1, 10, 1000) == toxicity.MIN_DOCS
    assert toxicity.least_documents(50_000, 100, 1000) == 5 < toxicity.least_documents(50_000, 500, 1000)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "You idiot", 5.0), (2, None, 1.0), (3, "", 0.0), (None, "a b", 2.0), (1, "You idiot", 5.0)], "doc_id long, text string, score double")
    for labels in ([], [(1, 1)], [(None, 1), (2, None)], [(1, 1), (1, 1), (2, 0), (3, 0)]):
        model = toxicity.fit_tables(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        rows = toxicity.score(docs, model).collect()
        assert len(rows) == 5 and [r.score >= 0.5 for r in sorted(rows, key=lambda r: r.doc_id or 9)] == [True, True, False, False, False]
    assert toxicity.score(docs.limit(0), toxicity.Model()).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_toxic_documents_are_found(spark):
    docs, labels = spread(table(spark, SF, "documents")), table(spark, SF, "labels")
    model = toxicity.fit_tables(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").select("doc_id", "score", "toxic").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    toxic, clean = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    assert sum(s >= 0.5 for s in toxic) >= 0.93 * len(toxic)  # six of 97 hold none of the words that tell toxic documents
    assert sum(s >= 0.5 for s in clean) <= 0.005 * len(clean)

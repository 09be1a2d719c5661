"""Filter orders against a plain replay, with nulls, repeats, ties and clashing columns."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from quarry.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, mask int, part int, digest string, words string, good int"
LABELS = "doc_id long, quality int, toxic int, id long, first boolean"


def corpus():
    rng = random.Random(3)
    words = "alpha Beta gamma DELTA one two #tag 50% a|b x".split()
    texts = [None, "", " \t\n", "A" * 50, "word " * 250, " ".join(f"w{k}" for k in range(400)), "long " + " ".join(f"W{k % 300}" for k in range(30_000))]
    texts += [" ".join(rng.choice(words) + str(rng.randrange(rng.choice([3, 900]))) for _ in range(rng.randrange(150, 260))) for _ in range(40)]
    texts += texts[7:15] + [None, texts[3]]
    rows = [(k, t, rng.choice(["s1", "s2", "", None])) for k, t in enumerate(texts)]
    return rows + [rows[3], rows[3], rows[20], (None, texts[9], "s1"), (None, texts[9], "s1"), (None, "only here", None)]


def plain(rows, labels):
    good, toxic = {d for d, q, _ in labels if d is not None and q == 1}, {d for d, _, t in labels if d is not None and t == 1}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = Counter()
    facts = []
    for d, t, s in rows:
        t = t or ""
        w = [x for x in re.split(r"[ \t-\r]+", t) if x]
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and least[t] < d,
        }
        facts.append((s or "", fails, d in good, d in toxic))
    shapley = Counter()
    for order in map("".join, permutations("ABCDE")):
        for part, fails, g, x in facts:
            first = next((k for k, f in enumerate(order) if fails[f]), 5)
            for k, f in enumerate(order):
                key = (part, order, k + 1)
                out[key, "kept"] += first > k
                out[key, "removed"] += first == k
                out[key, "redundant"] += fails[f] and first < k
                out[key, "unique_fails"] += fails[f] and sum(fails.values()) == 1
                out[key, "good_lost"] += first == k and g
                out[key, "toxic_lost"] += first == k and x
                shapley[part, f] += first == k
    return out, shapley


@pytest.mark.parametrize("some", [True, False])
def test_counts_equal_a_plain_replay(spark, some):
    rows = corpus() if some else []
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 40, 2)] + [(6, 1, None), (6, 0, 1), (8, None, None), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(d, t, s, 1, 2, "x", "y", 3) for d, t, s in rows], SCHEMA).repartition(3)
    found = filter_audit.replay(filter_audit.document_flags(docs, spark.createDataFrame([(*r, 1, True) for r in labels], LABELS))).collect()
    want, shapley = plain(rows, labels)
    assert len(found) == len({s or "" for _, _, s in rows}) * 600
    for r in found:
        key = (r.part, r.filter_order, r.step)
        for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[c] == want[key, c], (key, c)
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]], key


def test_other_numbers_of_filters(spark):
    flags = spark.createDataFrame([("p", m, False, False) for m in (0, 1, 2, 3)], "part string, mask int, good boolean, toxic boolean")
    found = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in filter_audit.replay(flags, "AB").collect()}
    assert found == {("AB", 1): (2, 2, 0, 3), ("AB", 2): (1, 1, 1, 3), ("BA", 1): (2, 2, 0, 3), ("BA", 2): (1, 1, 1, 3)}

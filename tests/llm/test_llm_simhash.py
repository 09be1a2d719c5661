"""Fingerprints and likeness against plain Python."""

import math
import re

import xxhash

from quarry.llm import simhash

TEXTS = ["", None, "one two", "One  TWO", " ".join(f"w{k}" for k in range(40)), " ".join(f"w{k}" for k in range(41)), "ÄÖ ü é " * 30, "x\ty\nz " * 50, "same text here again and again " * 9, "same text here again and again " * 9]


def plain(text):
    w = [x for x in re.split(r"[ \t-\r]+", (text or "").lower()) if x]
    terms = []
    for run in [w[k : k + 5] for k in range(len(w) - 4)] if len(w) >= 5 else []:
        h = 42
        for x in run:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        terms.append(h)
    if w and len(w) < 5:
        terms = [xxhash.xxh64_intdigest(" ".join(w).encode(), 42)]
    bits = sum(1 << b for b in range(64) if 2 * sum(t >> b & 1 for t in terms) > len(terms))
    return bits, len(terms)


def alike(a, b):
    if not a[1] and not b[1]:
        return 1.0
    if not a[1] or not b[1]:
        return 0.0
    return 1.0 if a[0] == b[0] else max(0.0, math.cos(bin(a[0] ^ b[0]).count("1") / 64 * math.pi))


def test_rows_equal_a_plain_version(spark):
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in simhash.compare_with_edit(df).collect()}
    prints = [plain(t) for t in TEXTS]
    for i, t in rows:
        t, after = t or "", TEXTS[i - 1] or ""  # by descending id; after 0 comes the last
        cut = len(t) // 3
        edited, r = plain(t[: len(t) - cut] + after[:cut]), got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (f"{prints[i][0]:016x}", f"{edited[0]:016x}"), i
        assert abs(r.near_edited - alike(prints[i], edited)) < 1e-9 and abs(r.near_next - alike(prints[i], prints[i - 1])) < 1e-9

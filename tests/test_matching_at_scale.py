"""Joins that leave frequent keys out, or work in blocks, against plain searches."""

import random

import pytest

from quarry.operators import library, matching


def grams(text, n=4):
    flat = "".join(text.lower().split())
    return {flat[i : i + n] for i in range(len(flat) - n + 1)} if len(flat) >= n else {flat} - {""}


def best(left, right, within, top=8, least=0.12):
    out = set()
    for i, x in left:
        found = sorted(((-len(grams(x) & grams(y)), j, grams(y)) for j, y in right if grams(x) & grams(y) and not (within and i == j)), key=lambda r: r[:2])[:top]
        out |= {(i, j, -n, round(-n / min(len(grams(x)), len(g)), 6)) for n, j, g in found if -n / min(len(grams(x)), len(g)) >= least}
    return out


@pytest.mark.parametrize("within", [True, False])
def test_candidates_with_a_gram_that_all_have(spark, within):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(3, 7)))
    rows = [(k, "everywhere " + " ".join(word() for _ in range(rng.randrange(0, 9)))) for k in range(60)] + [(60, ""), (61, "ab"), (62, "ab"), (63, "every")]
    other = rows if within else [(100 + k, t) for k, t in rows[::2]] + [(300, "xyzw everywhere")]
    left, right = spark.createDataFrame(rows, "a long, t string"), spark.createDataFrame(other, "b long, u string")
    got = {(r.a, r.b, r.shared, r.overlap) for r in matching.gram_candidates(left, "a", "t", right, "b", "u", within=within).collect()}
    assert got == best(rows, other, within)


@pytest.mark.parametrize("block", [8, 1 << 20])
def test_keys_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(library, "BLOCK_CHARS", block)
    monkeypatch.setattr(library, "SHARE_CHARS", 200)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ab가\U0001f600") for _ in range(rng.randrange(n)))
    texts, keys = {word(12) for _ in range(80)} | {None, ""}, {word(5) for _ in range(40)} | {None, ""}
    found = library.substring_pairs(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(k,) for k in keys], "k string"), "k").collect()
    assert len(found) == len(set(found)) and {(r.t, r.k) for r in found} == {(t, k) for t in texts for k in keys if t and k and k in t}


def test_pairs_in_turn(spark):
    rng = random.Random(11)
    rows = [(g, left, right, rng.randrange(5) / 4) for g in range(6) for left in range(7) for right in range(7) if rng.random() < 0.7]
    want = set()
    for g in range(6):
        free = set(range(7))
        for left in range(7):
            options = sorted((-s, r) for h, k, r, s in rows if (h, k) == (g, left) and r in free)
            if options:
                want.add((g, left, options[0][1]))
                free.discard(options[0][1])
    found = matching.pairs_in_turn(spark.createDataFrame(rows, "g int, l int, r int, s double"), ["g"], "l", "r", "s").collect()
    assert {(r.g, r.l, r.r) for r in found} == want

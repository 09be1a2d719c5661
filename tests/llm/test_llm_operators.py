"""Each operator against a plain version of its contract, with nulls, empty and long texts, ties, repeats and odd tables."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, html, jaccard, packing, pii, quality, simhash, substrings, toxicity, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, node long, score double, key long"
WORDS = [w for w in "alpha beta gamma delta über naïve señor straße x1 3.5 don't (quote) e.g. — ok! the of and in".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", "\n", "  "]) for _ in range(n))


def corpus():
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one", "Two words", "five words make one shingle", "\U0001f600 " * 60, "日本語のテキスト" * 20, "a" * 300, "ab" * 200]
    base = [prose(rng, 120) for _ in range(12)]
    texts += base + base[:4] + [base[0].upper()]
    for k in range(10):  # near copies of one text, at different places
        w = base[5].split(" ")
        w[10 * k : 10 * k + 2] = ["changed"]
        texts.append(" ".join(w))
    passage = prose(rng, 70)
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 40) for _ in range(5)]
    texts.append(prose(rng, 30_000))  # very long
    texts += ["mail a.b@c-d.example.com, x@y.z_w@q.r and 10.0.0.255 or 1.2.3.4.5.6.7.8, not 300.1.1.1", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "call +1 (456) 555-2186 now, +49 30 1234567890123456789"]
    rows = [(k + 3, t) for k, t in enumerate(texts)]
    return rows + [rows[12], rows[12]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "xx", None, None, 1, 2, 3.0, 4) for i, t in corpus()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_bpe(docs, nothing):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = by_id(bpe.round_trip(docs, path, public_tokenizers.PATTERN))
    for i, t in corpus():
        ids = plain.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    again = bpe.decode_ids(bpe.encode_texts(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in again.collect()} == {i: t or "" for i, t in corpus()}
    assert bpe.round_trip(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_transducer_forgets_and_goes_on():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    codec.machine.most = 200
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("abcdefgh éß日\n'.") for _ in range(60))
        assert codec.encode(t) == array("I", plain.encode_ordinary(t)).tobytes()
    assert "".join(codec.decode(array("I", [ranks[b"\xe6"]]).tobytes())) == "�"


def test_packing(docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in corpus()}
    rows = packing.pack(docs, path, window=64).drop("ids").collect()
    times = Counter(i for i, _ in corpus())
    held = Counter()
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        held[r.doc_id] += r.length
    assert held == {i: n * len(ids[i]) for i, n in times.items()}
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert sorted(at) == list(range(len(at))) and all(at[s] == 64 for s in range(len(at) - 1))
    assert packing.pack(nothing, path).count() == 0


def test_word_tokenizer_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, t = packing.WordTokenizer(path), Tokenizer.from_file(path)
    rng = random.Random(2)
    cases = ["it's I'LL", "İstanbul ΣΑΣ ς", "a\x1cb \x85x\xa0y", "<|endoftext|>a b<|startoftext|>", "é x̣y", "x_y__z --'s", "12 345.67", "Ⅷ ½ ²"]
    cases += ["".join(rng.choice("abcXYZ '.,!_-0129éÉñßΣσ日́ \n") for _ in range(200)) for _ in range(200)]
    for c in cases:
        assert own.encode(c) == array("H", t.encode(c, add_special_tokens=False).ids).tobytes(), c


PAGES = [
    ("<html><body><nav><ul><li><a href='/a'>Menu</a></ul></nav><div class=ad>Buy the best of all now.</div><article><h1>T &amp;amp; H</h1><p>One <b>two</b><br>three&nbsp;four.<p>Five &lt;six&gt;</article><footer>&copy; x</footer></body></html>", "T &amp; H\nOne two three four.\nFive <six>"),
    ("<article><p>Kept.</p><aside>Side.</aside><form>F<input></form><script>var t='</p>';</script><style>p{}</style><!-- c <p>x --><div id='comments'><p>Reader.</p></div></article>", "Kept."),
    (None, ""),
    ("", ""),
    ("<p></p><div> \n </div>", ""),
]


def test_html(spark):
    df = spark.createDataFrame([(k, f"u{k}", h) for k, (h, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0])], "page_id long, url string, html string")
    got = html.extract(df).collect()
    assert len(got) == len(PAGES) + 1
    for r in got:
        assert r.text == PAGES[r.page_id][1] and r.n_chars == len(r.text)
    assert html.extract(df.limit(0)).count() == 0


def test_html_without_an_article_falls_back_to_the_blocks():
    long = "This is the story of the man who was in the house and of the things that he had with him on that day. " * 4
    page = f"<div><p>Short lead.</p><p>{long}</p><p>Short note.</p><p>{long}</p></div><div><p><a href=x>Link one</a> <a href=y>Link two</a></p><p>All rights reserved</p></div>"
    assert html.main_text(page).split("\n") == ["Short lead.", long.strip(), "Short note.", long.strip()]


def test_quality_and_toxicity_learn(spark):
    rng = random.Random(4)
    good = lambda: prose(rng, 80)
    rows, labels = [], []
    for i in range(400):
        bad, toxic = i % 4 == 0, i % 5 == 1
        t = good()
        if bad:
            t = " ".join(w + "***" for w in t.split())
        if toxic:
            t = t.replace("gamma", "gamma blergo" + rng.choice(["", "s", "man"]), 2) + " you idiot."
        rows.append((i, t, "xx", None, None, 1, 2, 3.0, 4))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None, "xx", None, None, 1, 2, 3.0, 4), (1001, "", "xx", None, None, 1, 2, 3.0, 4)]
    d, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    held = {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    q = by_id(quality.score(d, quality.fit_tables(d, lab)))
    t = by_id(toxicity.score(d, toxicity.fit_tables(d, lab)))
    assert len(q) == len(t) == len(rows)
    assert all(0 <= r["score"] <= 1 for r in (*q.values(), *t.values()))
    assert sum((q[i]["score"] >= 0.3) == truth[i][0] for i in held) > 0.95 * len(held)
    assert sum((t[i]["score"] >= 0.5) == truth[i][1] for i in held) > 0.95 * len(held)
    assert not toxicity.fit_tables(d.limit(0), lab).stems.keys() - toxicity.INSULTS
    assert quality.score(d, quality.fit_tables(d, lab.limit(0))).first()["score"] == 0.5


def test_grammar_contexts():
    s = toxicity.Scorer(toxicity.Model())
    assert s.matches("You are an idiot.") == {"insult at target": 1.0}
    assert s.matches("He is not an idiot.") == {"insult negated": 1.0}
    assert s.matches("She said: nothing. They wrote idiot") == {"insult reported": 1.0}
    assert s.matches("An idiot. Never mind.") == {"insult": 1.0}
    assert s.matches("I will kill you") == {"threat at target": 1.0}
    assert s.matches("") == {} and s.score({}) < 0.5 < s.score({"insult at target": 1.0})


def plain_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())
    return out


def plain_jaccard(rows):
    sets = plain_sets(rows)
    label = {i: i for i in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_jaccard(docs, nothing):
    rows = jaccard.components(docs).collect()
    assert len(rows) == len(corpus())
    want = plain_jaccard(corpus())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    kept = [r.doc_id for r in jaccard.keep_one_of_each(docs).collect()]
    assert set(kept) == {i for i, (_, c) in want.items() if i == c}
    assert jaccard.components(nothing).count() == 0


def test_jaccard_of_sizes_around_all_borders(spark):
    rng = random.Random(8)
    rows, at = [], 0
    for n in (5, 8, 20, 33, 40, 41, 44, 45, 52, 80, 82, 99, 165, 330):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
        for cut in (0, 1, n // 10, n // 5, n // 5 + 1, n // 4):
            rows.append((at, " ".join(words[: len(words) - cut])))
            at += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df).collect()} == plain_jaccard(rows)


def test_region_join_in_blocks_connects_what_links_connect():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 150, dtype=np.uint64)
    sets = []
    for k in range(120):
        s = base.copy()
        at = rng.integers(0, 150, int(rng.integers(0, 40)))
        s[at] = rng.integers(0, 1 << 62, len(at), dtype=np.uint64)
        sets.append(np.unique(s))
    inter = np.array([[np.intersect1d(a, b).size for b in sets] for a in sets])
    size = np.array([len(s) for s in sets])
    linked = 100 * inter >= 80 * (size[:, None] + size[None, :] - inter)

    def labels(pairs):
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return [find(x) for x in range(len(sets))]

    want = labels(zip(*np.nonzero(linked), strict=True))
    assert labels(jaccard.region_join(sets)) == want
    half = np.array([k % 2 for k in range(120)])
    cross = labels(zip(*np.nonzero(linked & (half[:, None] != half[None, :])), strict=True))
    assert labels(jaccard.region_join(sets, half)) == cross


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows, at = [], 0
    for label in (0, 1):
        for _ in range(150):
            rows.append((at, rng.standard_normal(16).tolist(), label))
            at += 1
        centre = rng.standard_normal(16)
        for _ in range(60):
            rows.append((at, (centre + 0.02 * rng.standard_normal(16)).tolist(), label))
            at += 1
    rows += [(at, None, 0), (at + 1, [0.0] * 16, 0), (at + 2, [float("nan")] * 16, 0), (at + 3, rows[0][1], None), (at + 4, [None] * 16, 1), (at + 5, [1.0] * 8, 1), (at + 6, rows[5][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("unit", F.lit(1))
    got = by_id(vectors.near_duplicates(df), "vec_id")
    ok = [r for r in rows if r[1] and r[2] is not None and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    x = np.array([r[1] for r in ok], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = (x @ x.T >= 0.98) & np.equal.outer([r[2] for r in ok], [r[2] for r in ok])
    np.fill_diagonal(hit, False)
    assert [got[r[0]]["n_links"] for r in ok] == hit.sum(axis=1).tolist()
    for i, r in enumerate(ok):
        if hit[i].any():
            assert got[r[0]]["component_id"] <= min(ok[j][0] for j in np.flatnonzero(hit[i]))
    for i in range(at, at + 6):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert len(got) == len(rows) and vectors.near_duplicates(df.limit(0)).count() == 0


def test_dense_regions_are_followed_beyond_the_window(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 16)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(12)
    x = (centre + 0.02 * rng.standard_normal((150, 12))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = by_id(vectors.near_duplicates(df, passes=2), "vec_id")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    assert [got[i]["n_links"] for i in range(150)] == ((u @ u.T >= 0.98).sum(axis=1) - 1).tolist()
    assert {r["component_id"] for r in got.values()} == {0}


def test_repeated_passages(docs, nothing):
    rows = sorted({i: t for i, t in corpus()}.items())
    seen, want = set(), {}
    for i, t in rows:
        d = (t or "").encode()
        own, mask = [d[k : k + 50] for k in range(len(d) - 49)], bytearray(len(d))
        for k, w in enumerate(own):
            if w in seen:
                mask[k : k + 50] = b"\1" * 50
        seen.update(own)
        kept = bytes(c for c, m in zip(d, mask, strict=True) if not m)
        want[i] = (len(d), len(d) - len(kept), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest())
    got = substrings.remove_repeats(docs, carry=("lang",)).collect()
    assert len(got) == len(corpus())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert sum(n for _, n, _, _ in want.values()) > 1000
    assert substrings.remove_repeats(nothing).count() == 0


def test_simhash(spark, docs, nothing):
    rows = simhash.compare_with_edit(docs).collect()
    assert len(rows) == len(corpus())
    order = sorted(corpus(), key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        assert any(r.doc_id == i and r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() for r in rows), i
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    text = dict(corpus())
    prints = {}
    for r in rows:
        assert prints.setdefault((text[r.doc_id] or "").lower(), r.fingerprint) == r.fingerprint or text[r.doc_id].isspace()
    assert simhash.compare_with_edit(nothing).count() == 0
    assert simhash.compare_with_edit(docs.limit(1)).count() == 1


def test_simhash_pairs_within_the_radius(spark):
    rng = random.Random(9)
    f = [rng.getrandbits(64) for _ in range(60)]
    f += [f[k] ^ sum(1 << b for b in rng.sample(range(64), n)) for k in range(30) for n in (1, 3, 4)]
    signed = sorted({x - (1 << 64 if x >> 63 else 0) for x in f})
    df = spark.createDataFrame([(x,) for x in signed] * 2 + [(None,)], "fingerprint long")
    want = {(a, b, bin((a ^ b) & (1 << 64) - 1).count("1")) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert {tuple(r) for r in simhash.near_pairs(df, 3).collect()} == want


EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", m) for m in EMAIL.finditer(t)]
    out += [("ip", m) for m in IP.finditer(t) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    out += [("card", m) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_pii(spark, docs, nothing):
    rng = random.Random(6)
    odd = ["".join(rng.choice("ab@..-_%+ 0123456789()") for _ in range(300)) for _ in range(300)]
    odd += ["\U0001f600 x@y.de", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "+1" + "2" * 5000, "9" * 5000, "a" * 200_000 + "@b.c", "0" * 200_000 + ".1.2.3", "x@" + "a." * 20_000 + "a"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    want = dict(corpus()) | {1000 + k: t for k, t in enumerate(odd)}
    for i, r in by_id(pii.report(df)).items():
        base = plain_pii(want[i] or "")
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), want[i][:200]
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [base.count(f"{k}:") for k in pii.KINDS]
    assert pii.report(nothing).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "Mail a@b.com or 10.0.0.1!", 5), (2, None, 1), (3, "nothing", 2)], "doc_id long, text string, candidates int")
    assert {r.doc_id: r.text for r in pii.redact(df).collect()} == {1: "Mail [EMAIL] or [IP]!", 2: None, 3: "nothing"}


def test_reliabilities_tell_good_labelers_from_bad():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.5
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1 for p in (0.95, 0.9, 0.55)], axis=1)
    distinct, counts = np.unique(votes, axis=0, return_counts=True)
    _, right, prior = pii.expectation_maximisation(distinct.astype(float), counts.astype(float))
    assert right[0] > right[1] > right[2] and abs(prior - 0.5) < 0.05


def test_words_of_many_texts_learnt_together(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    own, t = packing.WordTokenizer(path), Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "MAX_MEMO", 8)
    texts = ["", "One two&&& ünd** two", "a\x1cb One", "naïve Straße, 12x İx ΑΣ İ", "two!? don't ### x.y", "One two&&& three four five six seven eight nine"]
    for _ in range(2):
        assert [np.frombuffer(i, f"<u{own.id_of.itemsize}").tolist() for i in own.encode_all(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]

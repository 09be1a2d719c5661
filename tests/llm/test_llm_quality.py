"""Statistics and the compiled rules against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import quality
from quarry.llm.html import STOP_WORDS

TEXTS = [None, "", "one", "The cat sat on the mat. The cat sat!\n\nNEXT line, 12 | 34 ***\nThe cat sat on the mat. The cat sat!", "word " * 50, "ÄÖ ß 日本 \U0001f600\n\t\x07", "a\nb\nc."]


def plain(text):
    if not text:
        return {s: 0.0 for s in quality.STATISTICS}
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    m, n = max(1, len(words)), len(text)
    up, letters = sum(c.isupper() for c in text), sum(c.isalpha() for c in text)
    pairs = list(zip(words, words[1:], strict=False))
    return {
        "chars": math.log1p(n), "words": math.log1p(len(words)), "word_length": sum(not c.isspace() for c in text) / m, "upper": up / letters if letters else 0.0, "digits": sum(c.isnumeric() and not c.isalpha() for c in text) / n,
        "marks": sum(c in "!?" for c in text) / n, "bars": text.count("|") / n, "spaces": sum(c.isspace() for c in text) / n, "distinct_words": len(set(words)) / m, "top_word": max(Counter(words).values(), default=0) / m,
        "repeated_next": sum(a == b for a, b in pairs) / m, "stop_words": sum(w.lower().strip(".,;:!?") in STOP_WORDS for w in words) / m, "lines": math.log1p(len(lines)), "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "line_length": n / max(1, len(lines)), "odd_ends": sum(x.rstrip()[-1] not in ".!?:;,\"')" for x in lines) / max(1, len(lines)), "distinct_pairs": len(set(pairs)) / max(1, len(words) - 1),
    }


@pytest.mark.parametrize("text", TEXTS)
def test_statistics(text):
    got = dict(zip(quality.STATISTICS, quality.statistics(text or ""), strict=True))
    for name, value in plain(text).items():
        assert abs(got[name] - value) < 1e-9, (name, got[name], value)


def test_compiled_rules_equal_the_plain_ones(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["the", "Cat", "12", "***", "of", "zz!", "a\n"]) for _ in range(rng.randrange(1, 60))) for _ in range(120)] + ["", None]
    x = np.array([quality.statistics(t or "") for t in texts])
    y = np.array([float((t or "").count("***") < 4) for t in texts])
    model = quality.fit(x, y)
    assert len(model.rules) > 1
    want = []
    for row in x:
        z = model.intercept + sum(w for rule, w in model.rules if all((row[j] > t) == above for j, above, t in rule))
        want.append(1 / (1 + math.exp(-z)))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert all(abs(got[k] - w) < 1e-9 for k, w in enumerate(want))
    assert quality.score(df.limit(0), model).count() == 0
    assert quality.fit_tables(df, spark.createDataFrame([], "doc_id long, quality int")).rules == []

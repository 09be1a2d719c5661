"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, centroids, filter_audit, html, jaccard, packing, pii, quality, simhash, substrings, toxicity, vectors, warc
from quarry.session import spread, table

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    """Scores as the contract has them."""
    fold = toxicity.held_out_fold("doc_id") == toxicity.HELD_OUT
    return scored.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text; null texts are empty and have none."""
    return pii.report(spread(table(spark, sf_dir, "documents")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies over all documents; texts without words link with nothing."""
    return jaccard.components(spread(table(spark, sf_dir, "documents")))


def op3_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors by label; unusable vectors and null labels are their own component."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learned from labelled rows outside the held-out fold; empty texts are scored, too."""
    docs = spread(table(spark, sf_dir, "documents"))
    return _judged(quality.score(docs, quality.fit_tables(docs, table(spark, sf_dir, "labels"))), 0.3)


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the passages that documents of smaller ids hold; null texts are empty."""
    return substrings.remove_repeats(spread(table(spark, sf_dir, "documents"))).drop("kept")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, its edit and the next document's; null texts are empty, equal ones have equal prints."""
    return simhash.compare_with_edit(spread(table(spark, sf_dir, "documents")))


def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from labelled rows outside the held-out fold; empty texts are scored, too."""
    docs = spread(table(spark, sf_dir, "documents"))
    return _judged(toxicity.score(docs, toxicity.fit_tables(docs, table(spark, sf_dir, "labels"))), 0.5)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null and empty pages have none."""
    return html.extract(spread(table(spark, sf_dir, "pages")))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; null texts are empty and have no ids."""
    return bpe.round_trip(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids; an empty document is its end mark."""
    return packing.pack(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(WORD_TOKENIZER)).drop("ids")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of the five filters over the whole corpus, by source; null sources count as the empty one."""
    return filter_audit.replay(filter_audit.document_flags(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives in the shared folder and read back by byte ranges; null pages are empty."""
    return warc.round_trip(spread(table(spark, sf_dir, "pages")))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of 64 finite components; others have no row."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))[0]


QUERIES = {f.__name__: f for f in (op1_pii, op2_jaccard_join, op3_projection_passes, op4_quality_rules, op5_repeated_passages, op6_simhash, op7_html_extraction, op8_toxicity_grammar, op9_bpe_round_trip, op10_packing, op11_filter_audit, op12_warc, op13_centroids)}


def _lloyd_sql(k: int = centroids.K, rounds: int = centroids.ROUNDS) -> str:
    """Lloyd's rounds written out, for components of which products fit a double."""
    nearest = "SELECT vec_id, e, min_by(c, {{d: d, c: c}}) AS c, min(d) AS d FROM (SELECT v.vec_id, v.e, m.c, list_dot_product(v.e, v.e) - 2 * list_dot_product(v.e, m.e) + list_dot_product(m.e, m.e) AS d FROM v, m{r} AS m) GROUP BY vec_id, e"
    parts = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"m0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, e FROM v ORDER BY sha256('2:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({nearest.format(r=r)})")
        parts.append(f"s{r} AS (SELECT c, i, floor(sum(e[i]) / count(*)) AS x FROM a{r}, unnest(generate_series(1, 64)) AS u(i) GROUP BY c, i)")
        parts.append(f"m{r + 1} AS MATERIALIZED (SELECT m.c, coalesce(n.e, m.e) AS e FROM m{r} AS m LEFT JOIN (SELECT c, list(x ORDER BY i) AS e FROM s{r} GROUP BY c) AS n ON n.c = m.c)")
    parts.append(f"z AS MATERIALIZED ({nearest.format(r=rounds)})")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, CAST(z.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(list_transform(m.e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM z JOIN m{rounds} AS m ON m.c = z.c
"""


SQL: dict[str, str] = {
    "op11_filter_audit": r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT doc_id, part, CAST(len(ws) < 200 AS INT) AS a, CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT) AS b, CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT) AS c,
CAST(regexp_matches(t, '[#$%&*|]') AS INT) AS d, CAST(doc_id > min(doc_id) OVER (PARTITION BY t) AS INT) AS e FROM w),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, MAP {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS s, a + b + c + d + e AS fails, quality, toxic FROM f LEFT JOIN l USING (doc_id)),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM k p, k q, k r, k s, k t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
m AS (SELECT part, filter_order, fails, quality, toxic, list_position(list_transform(string_split(filter_order, ''), lambda x: s[x]), 1) AS first, s FROM g, o),
n AS (SELECT part, filter_order, i AS step, substr(filter_order, i, 1) AS x, coalesce(first, 6) AS first, s[substr(filter_order, i, 1)] AS bad, fails, quality, toxic FROM m, unnest(generate_series(1, 5)) AS u(i)),
r AS (SELECT part, filter_order, step, x, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed, count(*) FILTER (bad = 1 AND first < step) AS redundant, count(*) FILTER (bad = 1 AND fails = 1) AS unique_fails,
count(*) FILTER (first = step AND quality = 1) AS good_lost, count(*) FILTER (first = step AND toxic = 1) AS toxic_lost FROM n GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
""",
    "op12_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT *, list_transform(generate_series(0, 7), lambda g: list_reduce(list_transform(string_split(substr(s, 5 * g + 1, 5), ''), lambda c: strpos('0123456789abcdef', c) - 1), lambda x, y: x * 16 + y)) AS fives FROM d)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(fives, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> k) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
""",
    "op13_centroids": _lloyd_sql(),
    # For ids that tell rows apart; shingles are compared by a 64-bit hash.
    "op2_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i : i + 4], ' ')) AS sh FROM w, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n AS x ON p.a = x.doc_id JOIN n AS y ON p.b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(node, label) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.label FROM r JOIN e ON r.node = e.a WHERE r.label < e.b),
c AS (SELECT node, min(label) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
""",
    "op3_projection_passes": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
r(node, label) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.label FROM r JOIN e ON r.node = e.a WHERE r.label < e.b),
c AS (SELECT node, min(label) AS component FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.component, v.vec_id) AS component_id, coalesce(c.component, v.vec_id) = v.vec_id AS kept FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.node = v.vec_id
""",
}

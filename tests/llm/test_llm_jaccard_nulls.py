"""Rows without an id link like others."""

from quarry.llm import jaccard


def text(*swapped):
    return " ".join(f"y{i}" if i in swapped else f"w{i}" for i in range(120))


def test_rows_without_an_id_link_and_bridge(spark):
    # 7 and 8 are 0.70 alike, each 0.84 like the row between them, which has no id.
    rows = [(7, text(20, 40)), (None, text(40, 60)), (8, text(60, 80)), (None, "quite another text of its own words"), (None, None), (9, text(3, 13, 23, 33, 43, 53, 63, 73))]
    rows += [(None, "z " + text(*range(0, 120, 2))), (None, text(*range(0, 120, 2)))]
    sets = [set(jaccard.shingles(t).tolist()) for _, t in rows]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    assert alike(0, 1) and alike(1, 2) and not alike(0, 2) and alike(6, 7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.components(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {7: 7, 8: 7, 9: 9}
    assert sorted((r.component_id is not None, r.component_id or 0) for r in got if r.doc_id is None) == [(False, 0)] * 4 + [(True, 7)]


def test_nodes_without_an_id_have_their_links(spark):
    df = spark.createDataFrame([(None, text()), (None, text(0)), (None, text(0))], "doc_id long, text string")
    assert jaccard.links(df, jaccard.nodes_of(df)).count() == 1

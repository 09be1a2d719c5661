"""What the classifier adds to the base spans, what labelers see, and how overlaps are masked."""

from quarry.llm import pii


def test_looser_candidates_are_added_where_the_labelers_agree(spark):
    rows = [(k, f"Please call my phone {200 + k} 555 {1000 + k} today") for k in range(40)]
    rows += [(100 + k, f"order tracking id x{300 + k} 555 {2000 + k}x shipped") for k in range(40)]
    rows += [(200 + k, f"mail me: ann{k} (at) example (dot) com or ann{k}@example.com") for k in range(20)]
    rows += [(300, None), (301, ""), (302, "nothing at all")]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and all(got[k].n_phone == 0 for k in range(40))
    assert all(got[k].spans == f"phone:21:{21 + 12}" for k in range(40))
    assert all(got[100 + k].spans == "" for k in range(40))
    for k in range(20):
        text = rows[80 + k][1]
        first, second = text.index("ann"), text.rindex("ann")
        assert got[200 + k].spans == f"email:{first}:{text.index(' or ')},email:{second}:{len(text)}" and got[200 + k].n_email == 1
    assert all(got[k].spans == "" for k in (300, 301, 302))


def test_labelers_see_different_things(spark):
    df = spark.createDataFrame([(1, "x4111 1111 1111 1111 and visa card 4111 1111 1111 1112, order 4111 1111 1111 1111.")], "doc_id long, text string")
    votes = {tuple(c.votes) for c in pii.with_candidates(df).select("candidates").first().candidates if pii.KINDS[c.kind] == "card" and not c.loose}
    assert votes == {(-1, 1, 1, 0, 0), (1, -1, 1, 1, 0), (1, 1, 1, 1, -1)}


def test_overlapping_kinds_are_masked_once(spark):
    # A phone number that is a card number, too: the one that begins first counts.
    df = spark.createDataFrame([(1, "a +4111111111111 b 10.0.0.1@x.com c")], "doc_id long, text string").withColumnRenamed("doc_id", "id")
    assert pii.redact(df).first().text == "a [PHONE] b [IP] c"  # one mark for all that overlaps
    assert pii.redact(df.limit(0)).count() == 0

"""The passes of the vector join follow from the largest label."""

from quarry.llm import vectors


def missed(n, passes):
    """Doubling labels past a chunk takes another common sign, each shared with probability 0.936."""
    alike = 1
    while n > vectors.CHUNK << alike:
        alike += 1
    return (1 - 0.93623**alike) ** passes


def test_stated_miss_rate_holds_at_every_size():
    assert [vectors.passes_for(n) for n in (0, 1, 600, 100_000, 131_072)] == [8] * 5
    assert [vectors.passes_for(n) for n in (1_000_000, 10_000_000)] == [10, 15]
    for k in range(10, 34):
        n = 3 << k
        assert missed(n, vectors.passes_for(n)) <= 1 / 699 and (vectors.passes_for(n) == 8 or missed(n, vectors.passes_for(n) - 1) > 1 / 701)


def test_passes_are_set_by_the_largest_label(spark, monkeypatch):
    seen, prepared = [], vectors._prepared
    monkeypatch.setattr(vectors, "CHUNK", 16)
    monkeypatch.setattr(vectors, "_prepared", lambda df, passes, *a: seen.append(passes) or prepared(df, passes, *a))
    monkeypatch.setattr(vectors, "PASSES", 1)
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, float(i + 1)], None if i < 300 else i % 3 // 2) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    vectors.near_duplicates(df.where("vec_id % 50 = 0"))
    assert seen == [vectors.passes_for(4)]
    monkeypatch.setattr(vectors, "_prepared", lambda df, passes, *a: seen.append(passes) or prepared(df, 1, *a))
    monkeypatch.setattr(vectors, "_ranked", lambda *a: 1 / 0)
    try:
        vectors.near_duplicates(df)
    except ZeroDivisionError:
        pass
    assert seen[-1] == vectors.passes_for(200) > seen[0]

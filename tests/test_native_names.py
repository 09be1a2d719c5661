"""Rules of names as expressions against their Python form."""

import itertools
import random

from quarry.functions import names, native_names

PARTS = [
    ["", "[김작가] ", "(완결) ", "0259276_", "12 ", "【가】", "[a][b] ", "@up "], ["겨울 항구", "푸른_등대", "Blue.Sky", "별", "1984", "S 외전", "...", "가나 다라마"],
    ["", " 3권", " 1-4권", " 12화", " 1~120화 완", " 2부", " 상", " 하권 완결", " 외전 2", " 007", " 텍본", " [완]", "-12", " 3부 15회", " 完 1-99 完"], ["", " (2)", "@tag", " #scan", " 완결", "_", " 리디", " - 저자"], ["", ".txt", ".EPUB", ".tar.gz", ".", ".a"],
]
ODD = ["", None, ".hidden", "..x.txt", "a/b\\c 2권.txt", "/", ".", "a/.", "  ", "０１２권.txt", "3권", "완결", "[x]", "(1).txt", "제목 １２화", "권", "1권2권3권.zip", "x" * 300 + " 5권", "a\tb 7화", "[가] (나) {다} 라 8권 (3).zip", "외전", "특별편 12", "A (1) (2).txt", "12345678_x.txt", "1_x.txt"]


def test_expressions_equal_the_rules(spark):
    rng = random.Random(1)
    made = ["".join(p) for p in itertools.product(*PARTS)]
    every = ODD + rng.sample(made, 1500)
    df = spark.createDataFrame([(k, n) for k, n in enumerate(every)], "k int, name string")
    columns = native_names.name_columns(df["name"])
    got = {r.k: r for r in df.select("k", *(c.alias(n) for n, c in columns.items())).collect()}
    for k, name in enumerate(every):
        want = dict(zip(names.FIELDS.names, names.fields_of(name or ""), strict=True))
        for field in columns:
            assert got[k][field] == want[field], (name, field)


def test_stems(spark):
    df = spark.createDataFrame([(k, n) for k, n in enumerate(n for n in ODD if n is not None)], "k int, name string")
    stem, extension = native_names.split_stem(df["name"])
    for r in df.select("name", stem.alias("s"), extension.alias("e"), native_names.base_name(df["name"]).alias("b"), native_names.drop_copy_mark(df["name"]).alias("c"), native_names.drop_source_tag(df["name"]).alias("t")).collect():
        assert (r.s, r.e) == names.split_stem(r.name) and r.b == names.base_name(r.name) and r.c == names.drop_copy_mark(r.name) and r.t == names.drop_source_tag(r.name), r.name

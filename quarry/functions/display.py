"""How names, numbers and changes are shown: titles for lists, marks of parts, roots of series, formats, highlights."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.names import base_name, natural_key

# Brackets, words and marks of the collection.
LIST_BRACKETS = r"^(?:\s*(?:\[[^\]]+\]|\([^)]+\)|\{[^}]+\}|【[^】]+】|〔[^〕]+〕|（[^）]+）)\s*)+"
WORK_BRACKETS = r"^\s*(?:\[[^\]]+\]|\([^)]+\)|\{[^}]+\})+"
SERIES_CUT = r"[\s_+-]*(?:\d+\s*(?:권|화|부|편)|외전|완결|完결|完(?![가-힣])|上|中|下)"
COVER_NOISE = (r"\[[^\]]*\]|\([^)]*\)", r"(?i)(?:e-?book|e북|전자책|외전|완결|본편|연재본?|합본|특별편)", r"\d+\s*(?:권|화|부|편)")
NOT_AUTHOR_MARKS = (
    "공금 갠소 공금갠소 교불 재업금지 연재 연재본 완결 완 본편 외전 특별편 합본 단편 텍본 무료 유료 bl gl br 판타지 로맨스 무협 현판 미포 포함 수정 개정판"
).split()
EXTENSION_ORDER = (".epub", ".txt", ".zip", ".cbz")
PARTS = (  # pattern, letter; the first group that is there is the number
    (r"(?i)(?:외전|번외|사이드\s*스토리)\s*[-_ ]*(\d+)?", "E"),
    (r"(?:^|[^0-9])(\d{1,3})\s*[~-]\s*(\d{1,3})\s*권", "M"),
    (r"(?:^|[^0-9])(\d+)\s*권", "M"),
    (r"(?:^|\s)(\d{1,3})\s*(?:완결|완)?$", "M"),
)
LEAST_COVER = 0.72


def _last(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*[/\\]", "")


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def listed_title(name: Column) -> Column:
    """The title that a list shows: without folder, extension and leading brackets of any kind."""
    stem = F.regexp_replace(_last(name), r"\.[^/.]+$", "")
    return _squeezed(F.regexp_replace(F.regexp_replace(stem, LIST_BRACKETS, ""), r"[_\-.]+", " "))


def work_title(name: Column) -> Column:
    """The title that works go by: escapes decoded, three kinds of leading brackets and a copy mark dropped, plus signs are spaces.

    Escapes stand for one UTF-16 unit each.
    """
    unescaped = F.when(name.contains("%"), _unescaped(name)).otherwise(name)
    stem = F.regexp_replace(_last(unescaped), r"\.[^/.]+$", "")
    bare = F.regexp_replace(F.regexp_replace(stem, WORK_BRACKETS, ""), r"\s*\(\d+\)\s*$", "")
    return _squeezed(F.regexp_replace(bare, r"[+_\-.]+", " "))


@F.pandas_udf(T.StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    import re

    return text.map(lambda t: t if t is None else re.sub(r"%u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), t))


def work_key(title: Column) -> Column:
    return F.lower(work_title(title))


def compact(title: Column) -> Column:
    """The key that likeness of titles is measured on."""
    return F.lower(F.regexp_replace(work_title(title), r"(?U)\s+", ""))


def part_token(name: Column) -> Column:
    """E and M with numbers for extras and volumes that a name states; null without any."""
    base = F.regexp_replace(F.regexp_replace(name, r"\.[^/.]+$", ""), r"\s*\(\d+\)\s*$", "")
    out = F.lit(None).cast("string")
    for pattern, letter in reversed(PARTS):
        first = F.regexp_extract(base, pattern, 1)
        label = F.concat(F.lit(letter), F.when(first == "", "1").otherwise(first))
        if pattern.count("(\\d") > 1:
            label = F.concat(label, F.lit("-"), F.regexp_extract(base, pattern, 2))
        out = F.when(base.rlike(pattern), label).otherwise(out)
    return out


def part_rank(name: Column) -> Column:
    """(kind, number): volumes, then extras, then names without a mark."""
    token = part_token(name)
    kind = F.when(token.startswith("M"), 0).when(token.startswith("E"), 1).otherwise(2)
    return F.struct(kind.alias("kind"), F.coalesce(F.regexp_extract(token, r"(\d+)", 1).try_cast("decimal(38,0)"), F.lit("9" * 38).cast("decimal(38,0)")).alias("number"))


def extension_rank(extension: Column) -> Column:
    out = F.lit(9)
    for k, e in reversed(list(enumerate(EXTENSION_ORDER))):
        out = F.when(F.lower(extension) == e, k).otherwise(out)
    return out


def catalog_order(series: Column, extension: Column, name: Column) -> list[Column]:
    """Series, kind of file, kind of part, number, name."""
    rank = part_rank(name)
    return [natural_key(series), extension_rank(extension), rank["kind"], rank["number"], natural_key(name)]


def series_root(title: Column) -> Column:
    """The title up to the first mark of a volume, episode or ending; whole if less than two characters stand before it."""
    before = F.regexp_extract(title, rf"(?s)^(.*?){SERIES_CUT}", 1)
    cut = F.regexp_replace(F.trim(before), r"[\s_+-]+$", "")
    return F.when(title.rlike(SERIES_CUT) & (F.length(before) >= 2) & (cut != ""), cut).otherwise(title)


def likely_author(name: Column) -> Column:
    """At most 20 characters with letters, no commas, none of the marks that brackets also hold."""
    low = F.lower(F.trim(name))
    return F.length(low).between(1, 20) & ~low.isin(*NOT_AUTHOR_MARKS) & ~low.contains(",") & low.rlike("[가-힣a-z]")


def cover_key(text: Column) -> Column:
    """Titles as covers are compared by: brackets, marks of editions and volumes, signs and spaces dropped."""
    for pattern in COVER_NOISE:
        text = F.regexp_replace(text, pattern, " ")
    return F.lower(F.regexp_replace(text, "[^0-9A-Za-z가-힣]+", ""))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def cover_score(title: Column, author: Column, found_title: Column, found_author: Column) -> Column:
    """How well a found book fits: likeness of titles, 0.9 at least if one holds the other, and 0.1 for the author. `LEAST_COVER` is enough."""
    a, b, who = cover_key(title), cover_key(found_title), cover_key(F.coalesce(author, F.lit("")))
    base = _ratio(a, b)
    base = F.when(a.contains(b) | b.contains(a), F.greatest(base, F.lit(0.9))).otherwise(base)
    score = base + F.when((who != "") & cover_key(F.coalesce(found_author, F.lit(""))).contains(who), 0.1).otherwise(0.0)
    return F.when((F.length(a) < 2) | (b == ""), 0.0).otherwise(score)


# --- formats -------------------------------------------------------------------------------------------------------


def short_list(values: Column, limit: int = 5) -> Column:
    rest = F.size(values) - limit
    return F.when(F.size(values) == 0, "-").otherwise(F.concat(F.array_join(F.slice(values, 1, limit), ", "), F.when(rest > 0, F.concat(F.lit(" ... (+"), rest, F.lit(")"))).otherwise("")))


def short_names(paths: Column, limit: int = 18) -> Column:
    """`short_list` of the last parts of paths."""
    return short_list(F.transform(paths, lambda p: F.regexp_replace(p, r"^.*/", "")), limit)


def short_hash(value: Column) -> Column:
    return F.when(F.length(value) <= 20, value).otherwise(F.concat(F.substring(value, 1, 8), F.lit("..."), F.right(value, F.lit(8))))


def signed_number(value: Column, unit: str = "") -> Column:
    return F.concat(F.when(value > 0, "+").otherwise(""), F.format_number(value, 0), F.lit(unit))


def zip_date(time: Column) -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM-dd HH:mm"), F.lit("-"))


def changed_words(text: Column, other: Column) -> Column:
    """(token, changed) of the words and what is between them: words that the other text lacks are changed."""
    tokens = F.regexp_extract_all(text, F.lit("[0-9A-Za-z가-힣]+|[^0-9A-Za-z가-힣]+"), F.lit(0))
    known = F.regexp_extract_all(other, F.lit("[0-9A-Za-z가-힣]+"), F.lit(0))
    return F.transform(tokens, lambda t: F.struct(t.alias("token"), (t.rlike("^[0-9A-Za-z가-힣]") & ~F.array_contains(known, t)).alias("changed")))


def merged_ranges(ranges: Column, length: Column) -> Column:
    """(start, end) ranges, cut to the text, in order, with those that overlap or touch as one."""
    cut = F.transform(ranges, lambda r: F.struct(F.greatest(r["start"], F.lit(0)).cast("int").alias("start"), F.least(r["end"], length).cast("int").alias("end")))
    inside = F.array_sort(F.filter(cut, lambda r: r["end"] > r["start"]))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        kept = F.slice(done, 1, F.size(done) - 1)
        return F.when(F.size(done) == 0, F.array(r)).when(r["start"] <= F.try_element_at(done, F.lit(-1))["end"], F.concat(kept, F.array(joined))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(inside, none, lambda d, r: add(d, r))


RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
DIFF = T.StructType([T.StructField("left", RANGES), T.StructField("right", RANGES), T.StructField("similarity", T.DoubleType())])


@F.pandas_udf(DIFF)
def diff_ranges(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Where two texts differ, and their likeness in percent."""
    out = []
    for a, b in zip(left, right, strict=True):
        matcher = difflib.SequenceMatcher(None, a or "", b or "", autojunk=False)
        steps = [s for s in matcher.get_opcodes() if s[0] != "equal"]
        out.append(([{"start": s[1], "end": s[2]} for s in steps if s[1] < s[2]], [{"start": s[3], "end": s[4]} for s in steps if s[3] < s[4]], round(100 * matcher.ratio(), 1)))
    return pd.DataFrame(out, columns=DIFF.names)


def name_of(path: str) -> str:
    return base_name(path)

"""The rules of names as expressions of the engine: titles, series, volumes, episodes, marks and stems without a Python worker.

They take names as they are shown (`names.display_name`: jamo composed, normalised, without format characters), which plain names are
already. The patterns are those of `names`, read with Unicode classes as there. Keys are in lower case, which for few letters is not the folded form;
numbers are read in ASCII and full-width digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import names

PASSES = 12  # of the series rules; each but the last takes at least one mark off
EDGES = " ._-"
WIDE = "０１２３４５６７８９"


def _u(pattern: str) -> str:
    """With Unicode classes, where a pattern's own flags allow it."""
    return "(?U)" + pattern


def _without(text: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(text, _u(pattern), to)


def _stripped(text: Column) -> Column:
    return _without(text, r"^\s+|\s+\z")


def base_name(path: Column) -> Column:
    """The last part of a path with either slash; empty without one."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def tidy(title: Column) -> Column:
    return F.btrim(_without(_without(title, r"[_\-.]+", " "), r"\s+", " "), F.lit(EDGES))


def split_stem(name: Column) -> tuple[Column, Column]:
    """Stem and extension; leading dots belong to the stem."""
    form = r"(?s)^((?:.*/)?\.*[^./][^/]*)(\.[^./]*)\z"
    has = name.rlike(form)
    return F.when(has, F.regexp_extract(name, form, 1)).otherwise(name), F.when(has, F.regexp_extract(name, form, 2)).otherwise("")


def drop_record_id(name: Column) -> Column:
    return _stripped(_without(split_stem(name)[0], r"^\d{2,7}[_\-. ]+"))


def drop_copy_mark(stem: Column) -> Column:
    return _stripped(_without(stem, r"\s*\(\d+\)\s*$"))


def drop_source_tag(title: Column) -> Column:
    short = F.btrim(_without(title, r"\s*[@#][^\[\]]*$"), F.lit(EDGES))
    return F.when(short == "", title).otherwise(short)


def book_title(name: Column) -> Column:
    stem = F.regexp_replace(base_name(name), r"\.[A-Za-z0-9]{2,5}$", "")
    return tidy(drop_copy_mark(_without(stem, rf"^(?:\s*(?:{names.BRACKETS})\s*)+")))


def series_title(name: Column) -> Column:
    """The title without volume, status and edition marks; the rules are repeated, and what has none left stays as it is."""

    def shorter(title: Column) -> Column:
        for rule in names.SERIES_RULES:
            title = _without(title, rule)
        return tidy(title)

    whole = book_title(name)
    last = F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), whole, lambda title, _: shorter(title))
    return F.when(last == "", whole).otherwise(last)


def volume_signature(name: Column) -> Column:
    """What tells two files of one title apart; empty without a mark."""
    title, out = book_title(name), F.lit("")
    for form, rule in reversed(names.SIGNATURE_RULES):
        pieces: list[Column] = []
        for k, piece in enumerate(form.replace("{1}", "{0}").split("{0}")):
            if k:
                found = F.regexp_extract(title, _u(rule), k)
                pieces.append(F.when(found == "", "0").otherwise(found))
            pieces.append(F.lit(piece))
        out = F.when(title.rlike(_u(rule)), F.concat(*pieces)).otherwise(out)
    return out


def _number(name: Column, rules: tuple[str, ...]) -> Column:
    """The largest number of the first rule that finds one, or 0."""
    stem = _without(drop_record_id(name), r"^(?:\s*(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|[@#])+\s*)+")
    text = _stripped(_without(_without(stem, r"[_.]+", " "), r"\s+", " "))
    found = []
    for rule in rules:
        groups = rule.count(names.NUMBER)
        values = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(_u(rule)), F.lit(g + 1)) for g in range(groups))))
        found.append(F.array_max(F.transform(F.filter(values, lambda v: v != ""), lambda v: F.translate(v, WIDE, "0123456789").try_cast("long"))))
    return F.coalesce(*found, F.lit(0).cast("long"))


def episode_number(name: Column) -> Column:
    return _number(name, names.EPISODE_RULES)


def volume_number(name: Column) -> Column:
    return _number(name, names.VOLUME_RULES)


def name_columns(name: Column) -> dict[str, Column]:
    """Title, series, their keys, mark and numbers, as `names.name_fields` has them. Null names count as empty."""
    name = F.coalesce(name, F.lit(""))
    title, series = book_title(name), series_title(drop_source_tag(drop_record_id(name)))
    return {
        "title": title, "series": series, "title_key": names.key_of(title), "series_key": names.key_of(series), "signature": volume_signature(name), "episode": episode_number(name), "volume": volume_number(name),
    }

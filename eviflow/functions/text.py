"""Column functions over text: normalisation, segmentation, matching with context.

All of them stay in the JVM except :func:`name_norm` with ``exotic=True``, which sends only the rare names outside
the Latin blocks to an Arrow UDF.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eviflow import fixed_values as fv

SPACE = r"[\s\x1c-\x1f]"
# Runs of whitespace other than one blank.
UNEVEN_SPACE = rf"(?U) {SPACE}+|[\s\x1c-\x1f&&[^ ]]{SPACE}*"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def given(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is mentioned."""
    return F.transform(F.array(value), use)[0]


# --- whitespace ----------------------------------------------------------------------------------
def trim_space(col: Column | str) -> Column:
    """Strip every kind of whitespace (``trim`` strips blanks only)."""
    return F.regexp_replace(_c(col), rf"(?U)^{SPACE}+|{SPACE}+$", "")


def collapse_space(col: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(col), UNEVEN_SPACE, " "))


def ws_norm(col: Column | str) -> Column:
    """Whitespace-collapsed lower-case text, null read as empty."""
    return F.lower(collapse_space(F.coalesce(_c(col), F.lit(""))))


def words(col: Column | str) -> Column:
    """Whitespace-separated words; an empty array for blank text."""
    flat = collapse_space(F.coalesce(_c(col), F.lit("")))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def word_count(col: Column | str) -> Column:
    return F.size(words(col))


def first_words(col: Column | str, n: int) -> Column:
    """Text cut to ``n`` words plus an ellipsis; shorter text stays verbatim."""
    parts = words(col)
    return F.when(F.size(parts) > n, F.concat(F.array_join(F.slice(parts, 1, n), " "), F.lit(" ..."))).otherwise(
        _c(col)
    )


# --- names ---------------------------------------------------------------------------------------
def _fold(char: str) -> str:
    stripped = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
    return stripped.upper()


def _latin_tables() -> tuple[str, str, str]:
    """(accented letters, their plain letters, combining marks) for the Latin blocks, built from Unicode data."""
    source, target = [], []
    for block in (range(0xA0, 0x250), range(0x1E00, 0x1F00), range(0xFF01, 0xFF5F)):
        for code in block:
            folded = _fold(chr(code))
            if len(folded) == 1 and folded.isascii():
                source.append(chr(code))
                target.append(folded)
    marks = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)))
    return "".join(source), "".join(target), marks


_ACCENTED, _PLAIN, _MARKS = _latin_tables()


@F.pandas_udf(T.StringType())
def _fold_any(names: pd.Series) -> pd.Series:
    return names.map(_fold, na_action="ignore")


def name_norm(col: Column | str, exotic: bool = True) -> Column:
    """Upper-case name with accents dropped, only letters, digits and single blanks.

    Latin letters are folded by ``translate``; ``exotic=False`` leaves the Arrow UDF for other scripts out of the
    plan (their letters then become blanks).
    """
    raw = F.coalesce(_c(col), F.lit(""))
    plain = F.translate(raw, _ACCENTED + _MARKS, _PLAIN)
    if exotic:
        rest = F.regexp_like(plain, F.lit(r"[^\x00-\x7f]"))
        plain = F.coalesce(_fold_any(F.when(rest, raw)), plain)
    return F.trim(F.regexp_replace(F.upper(plain), r"[^A-Z0-9]+", " "))


def token_sort(col: Column | str) -> Column:
    return F.array_join(F.array_sort(words(col)), " ")


# --- typography and currency ---------------------------------------------------------------------
def guard_norm(col: Column | str) -> Column:
    """Text as the guards read it: no markdown marks, plain quotes and dashes, dollar amounts written one way."""
    t = F.regexp_replace(F.coalesce(_c(col), F.lit("")), fv.MARKDOWN_RUN, "")
    t = given(t, lambda s: F.when(s.rlike("[’‘–—]"), F.translate(s, "’‘–—", "''--")).otherwise(s))
    t = F.regexp_replace(t, r"[ \t]{2,}|\t", " ")

    def dollars(s: Column) -> Column:
        written = F.regexp_replace(F.regexp_replace(s, fv.CURRENCY_PREFIX, r"\$"), fv.CURRENCY_CODE, r"\$")
        return F.regexp_replace(written, fv.CURRENCY_SUFFIX, r"\$$1")

    # Each of the three needs one of these; none of their letters has a further case variant.
    named = lambda s: F.contains(s, F.lit("a$")) | F.contains(s, F.lit("aud")) | F.contains(s, F.lit("dollar"))
    return given(t, lambda s: F.when(given(F.lower(s), named), dollars(s)).otherwise(s))


def cmp_norm(col: Column | str) -> Column:
    """Comparison form: guard form, collapsed, outer quotes and final full stops removed, lower case."""
    t = collapse_space(guard_norm(col))
    t = F.regexp_replace(t, r'^"+|"+$', "")
    return F.lower(F.regexp_replace(t, r"\.+$", ""))


def parse_money(col: Column | str) -> Column:
    """Whole amount of a money string; a comma or dot before three digits is a thousands mark."""
    t = F.regexp_replace(_c(col), r"[,.](?=\d{3}\b)", "")
    t = F.replace(F.substring_index(t, ".", 1), F.lit(","), F.lit(""))
    return t.try_cast("bigint")


def parse_digits(col: Column | str) -> Column:
    """Integer of a figure written with comma separators."""
    return F.replace(_c(col), F.lit(","), F.lit("")).try_cast("bigint")


# --- containment ---------------------------------------------------------------------------------
def contains_norm(text: Column | str, phrase: Column | str) -> Column:
    """Does the text hold the non-empty phrase, ignoring case and spacing?"""
    needle = ws_norm(phrase)
    return (needle != "") & F.contains(ws_norm(text), needle)


def quote_in_source(quote: Column | str, source: Column | str) -> Column:
    """Containment of a quotation, the truncation mark left aside."""
    return contains_norm(source, F.replace(_c(quote), F.lit(" ..."), F.lit("")))


def contains_cmp(text: Column | str, fact: Column | str) -> Column:
    """Containment in comparison form; an empty fact is never contained."""
    return (F.coalesce(F.length(_c(fact)), F.lit(0)) > 0) & F.contains(cmp_norm(text), cmp_norm(fact))


# --- segmentation --------------------------------------------------------------------------------
def sentence_array(col: Column | str) -> Column:
    """Verbatim sentences in order, blanks dropped."""
    parts = F.transform(F.split(trim_space(col), fv.SENTENCE_BREAK), trim_space)
    return F.filter(parts, lambda s: s != "")


def raw_sentences(col: Column | str) -> Column:
    """Sentence pieces without trimming, as the guards scan them."""
    return F.split(_c(col), fv.SENTENCE_BREAK)


def sentences_matching(col: Column | str, pattern: str) -> Column:
    return F.filter(raw_sentences(col), lambda s: s.rlike(pattern))


def alt_satisfied(col: Column | str, alt: str, need: str) -> Column:
    """Some sentence shows the alternative branch and is not negated."""
    return F.exists(
        raw_sentences(col), lambda s: s.rlike(alt) & s.rlike(need) & ~s.rlike(fv.NEGATION_WORD)
    )


def context(text: Column | str, start: Column, end: Column, width: int = fv.CONTEXT_WIDTH) -> Column:
    """Collapsed text around a 0-based span."""
    left = F.greatest(start - width, F.lit(0))
    return collapse_space(F.substring(_c(text), left + 1, end + width - left))


def matches(
    text: Column | str, core: str | Column, groups: dict[str, int], before: int = 0, ahead: int = 0, after: int = 0, needle: str = "", lower: bool = False
) -> Column:
    """All matches of ``core`` left to right as an array of structs of strings.

    ``groups`` names the captured groups wanted; ``before``/``after`` add that many characters around the match and
    ``ahead`` that many from its start. The surrounding text is captured by look-around, so matches stay contiguous.
    ``core`` must begin at the match start; look-ahead on it first keeps the context capture off other positions.
    ``needle`` is a string that every match holds (in lower case with ``lower``; without i, k and s, which have case variants
    of their own): a text without it is not searched.
    """
    n = _group_count(core)
    if needle:
        text = given(_c(text), lambda s: F.when(~F.contains(F.lower(s) if lower else s, F.lit(needle)), "").otherwise(s))
    subject = unmarked(text)
    subject = padded(subject, before) if before else subject
    pattern, fields, at = f"(?={core})", dict(groups), n
    if before:
        at += 1
        fields["before"] = at
        pattern += f"(?<=((?s:.{{{before}}})))"
    if ahead:
        at += 1
        fields["ahead"] = at
        pattern += f"(?=((?s:.{{0,{ahead}}})))"
    at += n
    # The core again, this time consuming; its groups repeat those of the look-ahead.
    pattern += f"(?:{_renumber(core, at - n)})"
    if after:
        at += 1
        fields["after"] = at
        pattern += f"(?=((?s:.{{0,{after}}})))"
    # One pass marks every match with the wanted groups, literal splits then take them apart.
    record = RECORD + FIELD.join(f"${g}" for g in fields.values()) + RECORD
    pieces = F.split(F.regexp_replace(subject, pattern, record), RECORD)
    rows = F.transform(F.filter(pieces, lambda p, i: i % 2 == 1), lambda p: F.split(p, FIELD))
    return F.transform(
        rows,
        lambda r: F.struct(
            *[
                (unpadded(r[i]) if name == "before" else r[i]).alias(name)
                for i, name in enumerate(fields)
            ]
        ),
    )


# Code points that Unicode keeps out of text.
RECORD = "\ufdd0"
FIELD = "\ufdd1"
PAD = "\u0000"


def unmarked(text: Column | str) -> Column:
    """Text without the two marks; ``contains`` is far cheaper than a replacement that finds nothing."""

    def dropped(s: Column) -> Column:
        return F.replace(F.replace(s, F.lit(RECORD), F.lit("")), F.lit(FIELD), F.lit(""))

    return given(_c(text), lambda s: F.when(F.contains(s, F.lit(RECORD)) | F.contains(s, F.lit(FIELD)), dropped(s)).otherwise(s))


def padded(text: Column | str, width: int) -> Column:
    """Text with filler in front, so that a fixed-length look-behind finds its characters everywhere (a
    variable-length one tries every length)."""
    return F.concat(F.lit(PAD * width), _c(text))


def unpadded(col: Column) -> Column:
    return F.ltrim(col, F.lit(PAD))


def _group_count(pattern: str) -> int:
    """Number of capturing groups (a bare opening bracket outside escapes and character classes)."""
    bare = re.sub(r"\\.", "", pattern)
    bare = re.sub(r"\[[^\]]*\]", "", bare)
    return len(re.findall(r"\((?!\?)", bare))


def _renumber(core: str, shift: int) -> str:
    """Shift numbered back-references of the repeated core."""
    return re.sub(r"\\(\d)(?!\d)", lambda m: f"\\{int(m.group(1)) + shift}", core)


def gaps_and_figures(text: Column | str, core: str) -> Column:
    """Array of (gap, figure): each figure with the text between it and the figure before it."""
    rows = F.split(F.regexp_replace(unmarked(text), core, f"{FIELD}$1{RECORD}"), RECORD)
    rows = F.transform(F.filter(rows, lambda r: F.contains(r, F.lit(FIELD))), lambda r: F.split(r, FIELD))
    return F.transform(rows, lambda r: F.struct(r[0].alias("gap"), r[1].alias("figure")))


def first_group(col: Column | str, pattern: str, group: int = 1) -> Column:
    """Captured group of the first match, null when there is none."""
    return given(F.regexp_extract(_c(col), pattern, group), lambda got: F.when(got != "", got))

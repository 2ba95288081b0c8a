"""Quality rules on generated texts, as column expressions that yield the list of reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BAD_STRUCTURE, EMPTY_OUTPUT, EMPTY_SECTION, FORBIDDEN, LIMITS, PART_TOO_LONG, QUOTES, SECTION_TOO_LONG, TITLES, TOTAL_TOO_LONG
from .binding import let
from .text import WS, normalize_text, visible_length

QUOTE_MARKS = "[“”\"《》]"


def has_forbidden_chars(c: Column) -> Column:
    return c.rlike("[A-Za-z0-9]")


def reasons(*rules: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(test, F.lit(reason)) for test, reason in rules)), lambda x: x.isNotNull())


def qc_section(content: Column | str) -> Column:
    """Reasons against one section's text; an empty list passes."""

    def judged(body: Column) -> Column:
        found = reasons((has_forbidden_chars(body), FORBIDDEN), (visible_length(body) > LIMITS.section_limit, SECTION_TOO_LONG), (body.rlike(QUOTE_MARKS), QUOTES))
        return F.when(body == "", F.array(F.lit(EMPTY_SECTION))).otherwise(found)

    return let(normalize_text(content), judged)


def split_sections(c: Column | str, mark_needed: bool = False, titles: tuple[str, ...] = TITLES) -> Column:
    """map<title, text> of a text cut at every title, wherever it stands; of repeated titles the last counts; null below one piece per title."""
    any_title, mark = "|".join(titles), "[:：]" if mark_needed else rf"{WS}*[:：]?"

    def cut(body: Column) -> Column:
        names = F.regexp_extract_all(body, F.lit(f"({any_title}){mark}"), F.lit(1))
        bodies = let(F.split(body, f"(?:{any_title}){mark}"), lambda pieces: F.slice(pieces, F.lit(2), F.size(pieces)))
        return F.zip_with(names, bodies, lambda n, b: F.struct(n.alias("name"), b.alias("body")))

    def kept(pieces: Column) -> Column:
        last = lambda t: normalize_text(F.try_element_at(F.filter(pieces, lambda z: z["name"] == t), F.lit(-1))["body"])
        return F.when(F.size(pieces) >= len(titles), F.map_from_arrays(F.lit(list(titles)), F.array(*map(last, titles))))

    return let(let(normalize_text(c), cut), kept)


def five_sections(c: Column | str) -> Column:
    """:func:`split_sections` where every title has text, else null."""
    return let(split_sections(c), lambda found: F.when(F.forall(F.map_values(found), lambda v: v != ""), found))


def qc_summary(c: Column | str, sections: Column | None = None) -> Column:
    """Reasons against a whole text. Pass the column of :func:`five_sections` where it is at hand."""

    def judged(body: Column, parts: Column) -> Column:
        forbidden = (has_forbidden_chars(body), FORBIDDEN)
        long = ((visible_length(parts[t]) > LIMITS.section_limit, t + PART_TOO_LONG) for t in TITLES)
        whole = reasons(forbidden, (visible_length(body) > LIMITS.total_limit, TOTAL_TOO_LONG), *long, (body.rlike(QUOTE_MARKS), QUOTES))
        torn = reasons(forbidden, (F.lit(True), BAD_STRUCTURE))
        return F.when(body == "", F.array(F.lit(EMPTY_OUTPUT))).when(parts.isNull(), torn).otherwise(whole)

    return let(normalize_text(c), lambda body: let(five_sections(c) if sections is None else sections, lambda parts: judged(body, parts)))


def failing_only(section_reasons: Column) -> Column:
    """map<title, reasons> without the sections that passed."""
    return F.map_filter(section_reasons, lambda _, v: F.size(v) > 0)

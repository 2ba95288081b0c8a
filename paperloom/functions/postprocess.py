"""Cleaning a generated text: an ordered program of replacements; the order matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TITLES
from .binding import let
from .quality import split_sections
from .text import WS, normalize_text, strip

ANY = "|".join(TITLES)
STOPS = rf"(?:[，,。；;、]|{WS})"
#: Applied in this order after the first normalisation.
RULES: tuple[tuple[str, str], ...] = (
    (rf"({ANY}){WS}*[:：]{{2,}}{WS}*", "$1："),
    (r"[:：]{2,}", "："),
    (rf"(研究问题[:：]{WS}*)(?:研究发现|发现|在于){WS}*", "$1"),
    (rf"(研究效果[:：]{WS}*)方面{WS}*", "$1"),
    (rf"([：:]){WS}*[，,]{WS}*", "$1"),
    (r"https?://[^\t-\r\x{1c}-\x{1f}\x{85}\p{Z}\x{4e00}-\x{9fa5}]+", ""),
    (r"www\.[^\t-\r\x{1c}-\x{1f}\x{85}\p{Z}\x{4e00}-\x{9fa5}]+", ""),
    (r"(?U)\b[a-zA-Z0-9\-]+\.(?:com|cn|net|org|edu|gov|info|io|co)(?:\.[a-zA-Z]{2})?\b", ""),
    *(rule for t in TITLES for rule in ((rf"({t}[:：]{WS}*)方面(?={STOPS})", "$1"), (rf"({t}[:：]{WS}*)方面{WS}+", "$1"))),
)


def _line(x: Column) -> Column:
    shape = rf"(?s)^({ANY})[:：]{WS}*(.*)\z"
    content = F.regexp_replace(strip(F.regexp_extract(x, shape, 2)), rf"^方面(?={STOPS}){WS}*", "")
    return F.when(x.rlike(f"^(?:{ANY})[:：]"), F.concat(F.regexp_extract(x, shape, 1), F.lit("："), content)).otherwise(x)


def cleaned_lines(c: Column | str) -> Column:
    """The rules and the pass over lines, without the last re-splitting."""
    t = normalize_text(c)
    for pattern, to in RULES:
        t = F.regexp_replace(t, pattern, to)
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: strip(x)), lambda x: x != "")
    return F.array_join(F.transform(lines, _line), "\n")


def rebuilt(lines: Column) -> Column:
    """One line per title in canonical order, or all on one line where there are fewer pieces than titles."""
    flat = lambda x: F.regexp_replace(x, rf"{WS}*\n+{WS}*", " ")
    whole = lambda parts: F.concat_ws("\n", *(F.concat(F.lit(f"{t}："), flat(parts[t])) for t in TITLES))
    return normalize_text(let(split_sections(lines, mark_needed=True), lambda parts: F.when(parts.isNotNull(), whole(parts)).otherwise(flat(lines))))

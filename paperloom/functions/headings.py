"""Recognising headings and the section that they open."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LIMITS, TAXONOMY
from .text import WS, strip, text


def normalize_heading(c: Column | str) -> Column:
    """Without white space, leading numbering and trailing marks. A leading bracketed numeral stays."""
    bare = F.regexp_replace(text(c), rf"{WS}+", "")
    unnumbered = F.regexp_replace(bare, r"^第?[零一二三四五六七八九十百千\p{Nd}]+[章节部分]?[、.．)）\-]*", "")
    return F.regexp_replace(unnumbered, r"[：:；;，,。.]+\z", "")


def match_section(c: Column | str, taxonomy=TAXONOMY) -> Column:
    """The section a heading opens: its exact name, else the first section one of whose aliases it contains; null for none."""
    heading = normalize_heading(c)
    exact = F.when(heading.isin(*(name for name, _ in taxonomy)), heading)
    alias = reduce(lambda found, rule: found.when(heading.rlike("|".join(map(re.escape, rule[1]))), F.lit(rule[0])), taxonomy, F.when(heading == "", F.lit(None).cast("string")))
    return F.coalesce(exact, alias)


def looks_like_heading(c: Column | str, style: Column | None = None, most: int = LIMITS.heading_chars) -> Column:
    """Not blank, and short or of a heading style."""
    bare = strip(text(c))
    styled = F.coalesce(style.contains("Heading") | style.contains("标题"), F.lit(False)) if style is not None else F.lit(False)
    return (bare != "") & (styled | (F.length(bare) <= most))

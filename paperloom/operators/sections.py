"""From ordered paragraphs to titled sections.

Texts stay in their row: lines, headings and sections are arrays, and nothing is exchanged. Paragraphs that come as rows (those
of word-processor files) go through windows and aggregates over their document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import LIMITS, TAXONOMY, TITLES
from ..functions.binding import let
from ..functions.headings import looks_like_heading, match_section
from ..functions.text import has_text, normalize_text, strip, text


def paragraphs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(<id>, pos, text): the lines of a text, normalised, without blank ones; ``pos`` is the place among all lines."""
    return df.select(id_col, F.posexplode(text_lines(text_col)).alias("pos", "text")).where("text <> ''")


def section_fill(paras: DataFrame, id_col: str, taxonomy=TAXONOMY, most: int = LIMITS.heading_chars) -> DataFrame:
    """Adds ``is_heading`` and ``section``: the last matched heading at or before a paragraph; unmatched headings change nothing."""
    style = F.col("style") if "style" in paras.columns else None
    marked = paras.withColumn("is_heading", looks_like_heading("text", style, most))
    opened = marked.withColumn("_opened", F.when(F.col("is_heading"), match_section("text", taxonomy)))
    upto = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return opened.withColumn("section", F.last("_opened", ignorenulls=True).over(upto)).drop("_opened")


def joined(value: str, sep: str = "\n", where: Column | None = None) -> Column:
    """Texts in order of ``pos``, joined."""
    item = F.struct("pos", value) if where is None else F.when(where, F.struct("pos", value))
    return F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x[value]), sep)


def section_records(paras: DataFrame, id_col: str, titles: tuple[str, ...] = TITLES, taxonomy=TAXONOMY) -> DataFrame:
    """(<id>, title, sections, full_text): one record per document; every section is present, empty where nothing was found."""
    filled = section_fill(paras, id_col, taxonomy)
    body = lambda t: joined("text", where=(F.col("section") == t) & ~F.col("is_heading"))
    one = filled.groupBy(id_col).agg(
        F.coalesce(F.min_by("text", F.when(F.length(strip(F.col("text"))) <= LIMITS.title_chars, F.col("pos"))), F.lit("")).alias("title"),
        *(body(t).alias(f"_s{i}") for i, t in enumerate(titles)),
        joined("text").alias("full_text"),
    )
    pairs = [x for i, t in enumerate(titles) for x in (F.lit(t), F.col(f"_s{i}"))]
    return one.select(id_col, "title", F.create_map(*pairs).alias("sections"), "full_text")


def text_lines(c: Column | str) -> Column:
    """array<string>: the normalised lines of a text, blank ones too."""
    return F.transform(F.split(text(c), r"\r\n|\r|\n"), normalize_text)


def marked_lines(c: Column | str, taxonomy=TAXONOMY, most: int = LIMITS.heading_chars) -> Column:
    """array<struct<text, is_heading, opened>> of the lines that are not blank; ``opened`` is the section that a heading opens."""
    shown = lambda x: F.struct(x.alias("text"), looks_like_heading(x, None, most).alias("is_heading"))
    opens = lambda m: F.struct(m["text"].alias("text"), m["is_heading"].alias("is_heading"), F.when(m["is_heading"], match_section(m["text"], taxonomy)).alias("opened"))
    return F.transform(F.transform(F.filter(text_lines(c), lambda x: x != ""), shown), opens)


def filled_parts(marked: Column) -> Column:
    """array<struct<section, lines>>: the stretches between headings that open a section, with their lines that are no headings.

    The first stretch, before any such heading, has a null section. Only the headings that open a section are walked through, so a
    text of many lines costs one slice per heading.
    """
    numbered = F.transform(marked, lambda m, i: F.struct(i.alias("at"), m["opened"].alias("section")))
    opens = F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("section"))), F.filter(numbered, lambda m: m["section"].isNotNull()))

    def parts(o: Column) -> Column:
        end = lambda k: F.coalesce(F.get(o, k + 1)["at"], F.size(marked))
        body = lambda x, k: F.transform(F.filter(F.slice(marked, x["at"] + 1, end(k) - x["at"]), lambda m: ~m["is_heading"]), lambda m: m["text"])
        return F.transform(o, lambda x, k: F.struct(x["section"].alias("section"), body(x, k).alias("lines")))

    return let(opens, parts)


def text_records(df: DataFrame, id_col: str, text_col: str, titles: tuple[str, ...] = TITLES, taxonomy=TAXONOMY) -> DataFrame:
    """:func:`section_records` of texts: (<id>, title, sections, full_text) for every text with a line that is not blank."""
    marked = df.where(has_text(text_col)).select(id_col, marked_lines(text_col, taxonomy).alias("_marked"))
    lines = F.transform("_marked", lambda m: m["text"])
    short = F.get(F.filter(lines, lambda x: F.length(strip(x)) <= LIMITS.title_chars), F.lit(0))
    own = lambda t: F.flatten(F.transform(F.filter("_parts", lambda p: p["section"] == t), lambda p: p["lines"]))
    pairs = [x for t in titles for x in (F.lit(t), F.array_join(own(t), "\n"))]
    parted = marked.select(id_col, F.coalesce(short, F.lit("")).alias("title"), filled_parts(F.col("_marked")).alias("_parts"), F.array_join(lines, "\n").alias("full_text"))
    return parted.select(id_col, "title", F.create_map(*pairs).alias("sections"), "full_text")


def section_counts(df: DataFrame, id_col: str, text_col: str, titles: tuple[str, ...] = TITLES, taxonomy=TAXONOMY) -> DataFrame:
    """(<id>, section, n_paragraphs, n_chars) of the sections that have paragraphs; those before any section have a null one."""
    marked = df.select(id_col, marked_lines(text_col, taxonomy).alias("_marked"))
    parts = marked.select(id_col, filled_parts(F.col("_marked")).alias("_parts"))
    own = lambda t: F.flatten(F.transform(F.filter("_parts", lambda p: p["section"].eqNullSafe(t)), lambda p: p["lines"]))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x))
    row = lambda t: let(own(t), lambda a: F.struct(F.lit(t).cast("string").alias("section"), F.size(a).cast("bigint").alias("n_paragraphs"), total(a).alias("n_chars")))
    rows = parts.select(id_col, F.explode(F.filter(F.array(*(row(t) for t in (None, *titles))), lambda x: x["n_paragraphs"] > 0)).alias("x"))
    return rows.select(id_col, "x.*")


def section_lengths(records: DataFrame, id_col: str, titles: tuple[str, ...] = TITLES) -> DataFrame:
    """(<id>, section, n_chars)."""
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("section"), F.length(text(F.col("sections")[t])).alias("n_chars")) for t in titles)))
    return records.select(id_col, rows.alias("r")).select(id_col, "r.section", "r.n_chars")

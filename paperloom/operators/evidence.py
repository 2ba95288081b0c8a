"""Evidence blocks: sections per document, repeated blocks out, a token budget, seeded jitter per variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import LIMITS, TITLES
from ..functions.binding import let
from ..functions.text import evidence_block, normalize_text
from .chunk import count_tokens, keep_first, running


def with_sections(docs: DataFrame, titles: tuple[str, ...] = TITLES) -> DataFrame:
    """Every document once per section; ``section_ord`` counts from 1."""
    return docs.select("*", F.posexplode(F.lit(list(titles))).alias("section_ord", "section")).withColumn("section_ord", F.col("section_ord") + 1)


def blocks(picks: DataFrame, title: str = "section", text_col: str = "text") -> DataFrame:
    return picks.withColumn("block", evidence_block(F.col(title), F.col(text_col))).where("block is not null")


def distinct_blocks(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """The first of equal blocks within a document. Blocks carry their section, so one text may serve two sections."""
    return keep_first(df, F.md5("block"), order, [id_col])


def clip(c: Column, most: int = LIMITS.block_chars, slack: int = LIMITS.block_slack, normal: bool = False) -> Column:
    """Blocks longer than ``most + slack`` are cut to ``most`` and marked. Texts that are normalised already are ``normal``."""
    return let(c if normal else normalize_text(c), lambda body: F.when(F.length(body) > most + slack, F.concat(F.substring(body, 1, most), F.lit("…"))).otherwise(body))


def budget_clip(df: DataFrame, within: list[str], order: list[str], budget: int = LIMITS.budget_tokens, block: str = "block") -> DataFrame:
    """Blocks up to, not including, the first that would exceed the budget; later smaller ones are not tried.

    Token counts are never negative, so the running sum only grows and a comparison per row is exact.
    """
    cut = df.withColumn(block, clip(F.col(block))).where(F.col(block) != "").withColumn("n_tokens", count_tokens(block))
    return cut.withColumn("used", running("n_tokens", within, order)).where(F.col("used") <= budget)


def measured(blocks: Column, size=None, normal: bool = False) -> Column:
    """array<struct<block, digest, shown, n>> of an array of blocks: its clipped form and that one's tokens. Blank ones are left out.

    What is done to a block once per variant or section reads these, so a block's tokens are counted once.
    """
    count = size or count_tokens
    row = lambda b: let(clip(b, normal=normal), lambda c: F.struct(b.alias("block"), F.md5(b).alias("digest"), c.alias("shown"), count(c).cast("bigint").alias("n")))
    return F.filter(F.transform(blocks, row), lambda m: m["shown"] != "")


def within_budget(rows: Column, budget: int = LIMITS.budget_tokens) -> Column:
    """:func:`budget_clip` in one array: the shown blocks up to, not including, the first that would exceed the budget."""
    step = lambda s, m: F.struct((s["used"] + m["n"]).alias("used"), (s["kept"] + F.when(s["used"] + m["n"] <= budget, 1).otherwise(0)).alias("kept"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("kept"))
    return let(rows, lambda a: F.transform(F.slice(a, F.lit(1), F.aggregate(a, start, step, lambda s: s["kept"])), lambda m: m["shown"]))


def jittered(rows: Column, key: Column, variant: Column, drop: float = LIMITS.jitter_drop, most: int = LIMITS.jitter_most, seed: int = LIMITS.seed) -> Column:
    """:func:`jitter` of the measured blocks of one array, for one variant."""
    draw = lambda m, what: uniform(key.cast("string"), variant.cast("string"), m["digest"], F.lit(what), seed=seed)
    kept = F.filter(rows, lambda m: draw(m, "drop") > drop)
    placed = F.array_sort(F.transform(kept, lambda m: F.struct(draw(m, "order").alias("place"), m["block"].alias("block"), m["shown"].alias("shown"), m["n"].alias("n"))))
    return F.slice(placed, 1, most)


def uniform(*parts: Column, seed: int = LIMITS.seed) -> Column:
    """A number in [0, 1) drawn from the digest of its parts, the same on every run and engine."""
    digest = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def jitter(df: DataFrame, id_col: str, variants: int = LIMITS.variants, drop: float = LIMITS.jitter_drop, most: int = LIMITS.jitter_most, seed: int = LIMITS.seed) -> DataFrame:
    """Each document's blocks once per variant, shuffled, some dropped, at most ``most``. Retrieval has run before, once per document."""
    each = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("variant"))
    parts = (F.col(id_col).cast("string"), F.col("variant").cast("string"), F.md5("block"))
    kept = each.withColumn("_draw", uniform(*parts, F.lit("drop"), seed=seed)).where(F.col("_draw") > drop)
    ranked = kept.withColumn("place", F.row_number().over(Window.partitionBy(id_col, "variant").orderBy(uniform(*parts, F.lit("order"), seed=seed), "block")))
    return ranked.where(F.col("place") <= most).drop("_draw")

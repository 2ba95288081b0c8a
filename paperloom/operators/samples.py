"""Chat samples: prompts, encoding with masked labels, supervision filter, exact seeded splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ASK, EVIDENCE_INTRO, LIMITS, QUALITY_TIP, SOURCE_HEAD, STYLE_EVIDENCE, STYLE_FULL, SYSTEM_EVIDENCE, SYSTEM_FULL
from ..functions.binding import let
from ..functions.text import has_text, normalize_text, strip, text
from . import align
from .chunk import paragraph_chunks
from .evidence import jittered, measured, uniform, within_budget
from .tokens import chat_text


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def source_text(full_text: Column, title: Column, sections: Column) -> Column:
    """The full text, or where it is blank the title and the sections that are not, put together."""
    shown = lambda e: let(normalize_text(e["value"]), lambda v: F.when(v != "", F.concat(e["key"], F.lit("：\n"), v)))
    head = let(normalize_text(title), lambda t: F.when(t != "", F.concat(F.lit("标题："), t)))
    parts = F.coalesce(F.transform(F.map_entries(sections), shown), F.array().cast("array<string>"))
    built = strip(F.array_join(F.concat(F.array(head), parts), "\n\n"))
    return let(normalize_text(full_text), lambda body: F.when(body != "", body).otherwise(built))


def has_source(full_text: Column, title: Column, sections: Column) -> Column:
    """Whether :func:`source_text` has text, told without making it."""
    return has_text(full_text) | has_text(title) | F.coalesce(F.exists(F.map_values(sections), has_text), F.lit(False))


def chat_samples(reports: DataFrame, seeds: DataFrame, order: str = "ord", size: int = LIMITS.chunk_chars, overlap: int = LIMITS.chunk_overlap) -> DataFrame:
    """(messages, meta): one sample per seed whose document has text."""
    parts = (F.col("full_text"), F.col("title"), F.col("sections"))
    docs = reports.where(has_source(*parts)).select(order, "title", source_text(*parts).alias("source"))
    targets = seeds.withColumn("target", normalize_text("target")).where("target <> ''")
    index = align.document_index(reports.select("doc_id", order), order)
    sources = align.with_last(align.matched(targets, index), docs, order, ["title", "source"])
    rows = sources.withColumn("chunks", paragraph_chunks("source", size, overlap)).withColumn("merged", strip(F.array_join("chunks", "\n\n")))
    user = F.concat(F.lit(f"{STYLE_FULL}\n\n{SOURCE_HEAD}"), F.col("merged"), F.lit(f"\n\n{ASK}"))
    meta = F.struct(
        "doc_id",
        "safe_doc_id",
        "seed_stem",
        "seed_path",
        normalize_text("title").alias("title"),
        F.size("chunks").alias("n_chunks"),
        F.length("merged").alias("source_chars"),
        F.length("target").alias("target_chars"),
    )
    return rows.select(F.array(message("system", F.lit(SYSTEM_FULL)), message("user", user), message("assistant", F.col("target"))).alias("messages"), meta.alias("meta"))


def evidence_samples(
    docs: DataFrame, id_col: str = "doc_id", variants: int = LIMITS.variants, tip_share: float = LIMITS.tip_share, budget: int = LIMITS.budget_tokens, seed: int = LIMITS.seed
) -> DataFrame:
    """(<id>, variant, messages) from (<id>, blocks, target): per variant the distinct (normalised) blocks, jittered and within the budget.

    Some prompts carry a reminder of the rules. A variant without a block has no ``messages``. Everything stays in the document's row.
    """
    rows = docs.select(id_col, "target", measured(F.array_distinct("blocks"), normal=True).alias("_rows"))
    one = lambda v: F.struct(v.alias("variant"), within_budget(jittered(F.col("_rows"), F.col(id_col), v, seed=seed), budget).alias("_chosen"))
    # Exploded ready-made, so that no later filter is pushed below and makes the choice twice.
    chosen = rows.select(id_col, "target", F.explode(F.transform(F.sequence(F.lit(0), F.lit(variants - 1)), one)).alias("_v")).select(id_col, "target", "_v.*")
    joined = chosen.withColumn("evidence", F.when(F.size("_chosen") > 0, F.array_join("_chosen", "\n\n")))
    tip = F.when(uniform(F.col(id_col).cast("string"), F.col("variant").cast("string"), F.lit("tip"), seed=seed) < tip_share, F.lit(QUALITY_TIP)).otherwise(F.lit(""))
    user = F.concat(F.lit(f"{STYLE_EVIDENCE}\n\n{EVIDENCE_INTRO}"), F.col("evidence"), tip, F.lit(f"\n\n{ASK}"))
    messages = F.array(message("system", F.lit(SYSTEM_EVIDENCE)), message("user", user), message("assistant", F.col("target")))
    return joined.select(id_col, "variant", F.when(F.col("evidence").isNotNull(), messages).alias("messages"))


def encoded_chat(samples_: DataFrame, ids, most: int = LIMITS.sequence, pad: int = 0) -> DataFrame:
    """Adds ``encoded``, all messages but the last under the chat template as prefix and the last as the answer, both through ``ids``, and
    ``n_supervised``, how many tokens of the answer have labels (told from the answer alone, so a filter on it needs no prefix)."""
    prefix = chat_text(F.slice("messages", F.lit(1), F.size("messages") - 1), answer_next=True)
    answer = F.element_at("messages", -1)["content"]
    rows = samples_.withColumn("_prefix", ids(prefix)).withColumn("_answer", ids(text(answer)))
    size = F.when(F.col("messages").isNotNull(), F.least(F.size("_answer"), F.lit(most)))
    return rows.select(*samples_.columns, encode(F.col("_prefix"), F.col("_answer"), most, pad).alias("encoded"), size.alias("n_supervised"))


def well_supervised(encoded: DataFrame, least: int = LIMITS.least_supervised) -> DataFrame:
    """The samples with enough tokens to learn from."""
    return encoded.where(F.col("n_supervised") >= least)


def encode(prefix: Column, answer: Column, most: int = LIMITS.sequence, pad: int = 0) -> Column:
    """struct<input_ids, attention_mask, labels>: the prefix has no labels, overflow drops the oldest tokens, padding is on the right."""
    ids, labels = F.concat(prefix, answer), F.concat(F.transform(prefix, lambda _: F.lit(-100)), answer)
    start = F.greatest(F.size(ids) - most, F.lit(0)) + 1
    missing = F.greatest(F.lit(most) - F.size(ids), F.lit(0))
    fill = lambda value: F.array_repeat(F.lit(value), missing)
    kept = lambda a: F.slice(a, start, F.lit(most))
    return F.struct(
        F.concat(kept(ids), fill(pad)).alias("input_ids"),
        F.concat(F.transform(kept(ids), lambda _: F.lit(1)), fill(0)).alias("attention_mask"),
        F.concat(kept(labels), fill(-100)).alias("labels"),
    )


def supervised(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != -100))


def supervision_report(encoded: DataFrame, least: int = LIMITS.least_supervised) -> DataFrame:
    n = supervised(F.col("encoded.labels"))
    counted = encoded.select(n.alias("n"))
    return counted.agg(F.count_if(F.col("n") < least).alias("dropped"), F.count_if(F.col("n") >= least).alias("kept"), F.min("n").alias("least"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))


def exact_split(df: DataFrame, key: str, ratio: float = LIMITS.valid_ratio, seed: int = LIMITS.seed) -> DataFrame:
    """Adds ``split``: exactly max(1, floor(n * ratio)) rows are ``valid``, those of the least digest of key and seed.

    The place of the cut is found from counts per digest prefix; only the prefix in which it falls is ordered, so no task sorts all rows.
    """
    drawn = df.withColumn("_draw", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))
    sizes = drawn.groupBy(F.substring("_draw", 1, 4).alias("_bucket")).agg(F.count(F.lit(1)).alias("_size"))
    upto = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_bucket")) - F.col("_size")).withColumn("_n", F.sum("_size").over(Window.partitionBy()))
    placed = drawn.withColumn("_bucket", F.substring("_draw", 1, 4)).join(F.broadcast(upto), "_bucket")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_bucket").orderBy("_draw", key))
    valid = rank <= F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))
    return placed.withColumn("split", F.when(valid, "valid").otherwise("train")).drop("_draw", "_bucket", "_size", "_before", "_n")


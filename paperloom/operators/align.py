"""Aligning reference texts with documents by keys of falling strictness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EMPTY_SOURCE
from ..functions.text import loose_key, normalize_text, safe_filename, text


def document_index(docs: DataFrame, order: str) -> DataFrame:
    """One row per identifier: (doc_id, doc_ord, last_ord, safe_doc_id) and the last record's other columns.

    ``doc_ord`` is the place of its first record, ``last_ord`` that of its last. Blank identifiers are left out. Minima and maxima are
    combined before the shuffle; leave large texts out of ``docs`` and fetch those of the rows that are needed with :func:`with_last`.
    """
    named = docs.withColumn("doc_id", normalize_text("doc_id")).where("doc_id <> ''")
    others = [c for c in docs.columns if c not in ("doc_id", order)]
    last = [F.max_by(F.struct(*others), order).alias("_last")] if others else []
    one = named.groupBy("doc_id").agg(F.min(order).alias("doc_ord"), F.max(order).alias("last_ord"), *last)
    return one.select("doc_id", "doc_ord", "last_ord", safe_filename("doc_id").alias("safe_doc_id"), *(["_last.*"] if others else []))


def with_last(rows: DataFrame, docs: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Rows of an index with columns of the last record of their document."""
    return rows.join(docs.select(F.col(order).alias("last_ord"), *columns), "last_ord")


def _keys(tiers: list) -> F.Column:
    return F.explode(F.array(*(F.struct(F.lit(i).alias("tier"), key.alias("key")) for i, key in enumerate(tiers, 1))))


def align(seeds: DataFrame, index: DataFrame, stem: str = "seed_stem") -> DataFrame:
    """(<stem>, doc_id, tier): for every distinct stem the document of the strictest tier, of several the first.

    Tiers: identifier, safe name, loose key of the identifier, loose key of the safe name. One equi join on (tier, key); both
    sides are cut to one row per key before it, so a key shared by many documents or stems stays one row.
    """
    names = seeds.select(F.col(stem).alias("stem")).where("stem is not null").distinct()
    s = names.select("stem", _keys([normalize_text("stem"), safe_filename("stem"), loose_key("stem"), loose_key("stem")]).alias("k"))
    d = index.select("doc_id", "doc_ord", _keys([F.col("doc_id"), F.col("safe_doc_id"), loose_key("doc_id"), loose_key("safe_doc_id")]).alias("k"))
    first = d.where("k.key <> ''").groupBy("k").agg(F.min_by("doc_id", "doc_ord").alias("doc_id"))
    hits = s.where("k.key <> ''").join(first, "k")
    return hits.groupBy("stem").agg(F.min_by("doc_id", "k.tier").alias("doc_id"), F.min("k.tier").alias("tier")).withColumnRenamed("stem", stem)


def matched(seeds: DataFrame, index: DataFrame) -> DataFrame:
    """Every seed with its document; a document may have several."""
    return seeds.join(align(seeds, index), "seed_stem").join(index, "doc_id")


def unmatched_seeds(seeds: DataFrame, index: DataFrame, source: str = "source") -> DataFrame:
    """(seed_stem, seed_path, reason): seeds without a document (null reason) and those whose document has no text."""
    found = align(seeds, index)
    none = seeds.join(found, "seed_stem", "left_anti").select("seed_stem", "seed_path", F.lit(None).cast("string").alias("reason"))
    blank = seeds.join(found, "seed_stem").join(index.where(text(source) == "").select("doc_id"), "doc_id")
    return none.union(blank.select("seed_stem", "seed_path", F.lit(EMPTY_SOURCE)))


def unmatched_docs(seeds: DataFrame, index: DataFrame) -> DataFrame:
    return index.join(align(seeds, index).select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "safe_doc_id")


def seed_map(seeds: DataFrame, index: DataFrame, order: str = "seed_path") -> DataFrame:
    """(doc_id, target): the last seed of each document."""
    found = seeds.join(align(seeds, index), "seed_stem")
    return found.groupBy("doc_id").agg(F.max_by("target", F.struct(F.col(order), F.col("target"))).alias("target"))

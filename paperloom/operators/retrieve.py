"""Vector retrieval: embeddings with a cache, cosine top-N, re-ranking for diversity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import LIMITS
from ..functions.text import cache_key
from ..sources.files import exists


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit(c: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    size = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(size > 0, F.transform(c, lambda x: x.cast("double") / size)).otherwise(F.transform(c, lambda x: x.cast("double")))


def cosine_topn(queries: DataFrame, chunks: DataFrame, on: list[str], query_id: str, chunk_id: str, n: int = LIMITS.top_n, digits: int = 6) -> DataFrame:
    """(<on>, <query_id>, <chunk_id>, sim, rank, emb, q_emb): the ``n`` most similar chunks of each query within its document.

    Vectors (``emb``) are at length 1. Ties go to the smaller chunk. The limit runs before the shuffle, so a query keeps
    ``n`` candidates per task however many chunks its document has.
    """
    q = queries.select(*on, query_id, F.col("emb").alias("q_emb"))
    pairs = chunks.select(*on, chunk_id, "emb").join(q, on)
    scored = pairs.withColumn("sim", F.round(dot("emb", "q_emb"), digits))
    best = Window.partitionBy(*on, query_id).orderBy(F.desc("sim"), chunk_id)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def mmr_order(sims: np.ndarray, vectors: np.ndarray, k: int, weight: float) -> list[int]:
    """Places of the picks: the most similar first, then by similarity less likeness to what is picked; ties to the smaller place."""
    picked: list[int] = []
    worst = np.full(len(sims), -np.inf)
    score = sims.copy()
    while len(picked) < min(k, len(sims)):
        best = int(np.argmax(score))
        picked.append(best)
        worst = np.maximum(worst, vectors @ vectors[best])
        score = weight * sims - (1 - weight) * worst
        score[picked] = -1e9
    return picked


def mmr_rerank(top: DataFrame, group: list[str], chunk_id: str, k: int = LIMITS.mmr_k, weight: float = LIMITS.mmr_lambda) -> DataFrame:
    """(<group>, <chunk_id>, sim, pick): a group holds at most the top-N candidates and travels as one row, a small matrix."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.col(chunk_id).alias("chunk"), "sim", "emb")))
    part = lambda name: F.transform("c", lambda x: x[name]).alias(f"_{name}")
    rows = top.groupBy(*group).agg(ranked.alias("c")).select(*group, part("chunk"), part("sim"), part("emb"))
    schema = T.StructType([*(top.schema[c] for c in (*group, chunk_id, "sim")), T.StructField("pick", T.IntegerType())])

    def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for *key, chunks, sims, vectors in batch.itertuples(index=False, name=None):
                places = mmr_order(np.asarray(sims, float), np.stack([np.asarray(v, float) for v in vectors]), k, weight)
                out += [(*key, chunks[i], sims[i], n) for n, i in enumerate(places, 1)]
            yield pd.DataFrame(out, columns=schema.names)

    return rows.mapInPandas(rerank, schema)


def hashed_embedder(dim: int = 64, gram: int = 2) -> Callable[[list[str]], np.ndarray]:
    """The stand-in embedder: counts of hashed character grams at length 1. It has the data flow of a model, not its quality."""

    def counts(text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        size = len(codes) - gram + 1
        if size < 1:
            return np.zeros(dim)
        with np.errstate(over="ignore"):
            mixed = np.zeros(size, np.uint64)
            for i in range(gram):
                mixed = (mixed ^ codes[i : size + i]) * np.uint64(0x9E3779B97F4A7C15)
        return np.bincount(((mixed >> np.uint64(32)) % np.uint64(dim)).astype(np.int64), minlength=dim)

    def embed(texts: list[str]) -> np.ndarray:
        out = np.stack([counts(t) for t in texts]).astype("float32") if texts else np.zeros((0, dim), "float32")
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed(df: DataFrame, text_col: str, provider: Callable[[], Callable[[list[str]], np.ndarray]] = hashed_embedder, batch: int = 32) -> DataFrame:
    """Adds ``emb``. The provider runs once per worker and encodes ``batch`` texts at a time."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider()
        for texts in batches:
            rows = texts.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(rows), batch) for v in model(rows[i : i + batch]).tolist()], dtype=object)

    return df.withColumn("emb", encode(F.col(text_col)))


def embed_lists(df: DataFrame, texts_col: str, provider: Callable[[], Callable[[list[str]], np.ndarray]] = hashed_embedder, batch: int = 32) -> DataFrame:
    """Adds ``embs``, a vector per text of an array, so that a document's chunks stay in its row."""

    @F.pandas_udf("array<array<float>>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider()
        for lists in batches:
            flat = [t or "" for texts in lists for t in (texts if texts is not None else ())]
            vectors = [v for i in range(0, len(flat), batch) for v in model(flat[i : i + batch]).tolist()]
            ends = np.cumsum([0 if texts is None else len(texts) for texts in lists])
            yield pd.Series([vectors[b - (0 if texts is None else len(texts)) : b] for texts, b in zip(lists, ends)], dtype=object)

    return df.withColumn("embs", encode(F.col(texts_col)))


def embed_documents(docs: DataFrame, cache: DataFrame | None = None, provider=hashed_embedder, model: str = "stand-in") -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, texts) with ``embs``, and the rows (key, chunk_idx, emb) to append to the cache.

    A document's cache counts only where it has as many vectors as the document has chunks; others are encoded anew.
    """
    keyed = docs.withColumn("key", cache_key(F.col("doc_id").cast("string"), F.col("texts"), model))
    if cache is None:
        fresh = embed_lists(keyed, "texts", provider)
        done = fresh
    else:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "emb"))), lambda x: x["emb"])
        found = keyed.join(cache.groupBy("key").agg(ordered.alias("embs")), "key", "left")
        whole = F.coalesce(F.size("embs") == F.size("texts"), F.lit(False))
        fresh = embed_lists(found.where(~whole).drop("embs"), "texts", provider)
        done = found.where(whole).select(*fresh.columns).unionByName(fresh)
    return done.drop("key"), fresh.select("key", F.posexplode("embs").alias("chunk_idx", "emb"))


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The cached vectors; None where nothing was cached yet."""
    return spark.read.parquet(path) if exists(spark, path) else None


def append_cache(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def pick_chunks(provider=hashed_embedder, n: int = LIMITS.top_n, k: int = LIMITS.mmr_k, weight: float = LIMITS.mmr_lambda, digits: int = 6) -> Callable[[Column, Column], Column]:
    """A column function from a document's chunk vectors and queries (array<string>) to array<array<int>>: per query the places of the
    chunks, top-N by cosine and then re-ranked, as :func:`cosine_topn` and :func:`mmr_rerank` do for rows.

    A query that many documents share is encoded once per task. An empty query or a document without chunks has no picks.
    """

    @F.pandas_udf("array<array<int>>")
    def picks(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = provider()
        vector = lru_cache(1024)(lambda q: np.asarray(model([q])[0], float))

        def picked(query: str | None, vectors: np.ndarray) -> list[int]:
            if not query or not len(vectors):
                return []
            sims = np.round(vectors @ vector(query), digits)
            top = np.lexsort((np.arange(len(sims)), -sims))[:n]
            return top[mmr_order(sims[top], vectors[top], k, weight)].tolist()

        for embs, queries in batches:
            rows = []
            for own, asked in zip(embs, queries):
                vectors = np.stack([np.asarray(e, float) for e in own]) if own is not None and len(own) else np.zeros((0, 0))
                rows.append([picked(q, vectors) for q in asked])
            yield pd.Series(rows, dtype=object)

    return picks


def embed_cached(chunks: DataFrame, cache: DataFrame, id_col: str, text_col: str, key: Column, provider=hashed_embedder) -> tuple[DataFrame, DataFrame]:
    """All chunks with ``key`` and ``emb``, and the rows to append to the cache.

    A document's cache counts only where it has as many rows as the document has chunks; others are encoded anew.
    """
    keyed = chunks.withColumn("key", key)
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    whole = cache.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(counts, ["key", "n"], "left_semi").select("key")
    hits = keyed.join(whole, "key", "left_semi").join(cache.select("key", "chunk_idx", "emb"), ["key", "chunk_idx"])
    fresh = embed(keyed.join(whole, "key", "left_anti"), text_col, provider)
    return hits.unionByName(fresh), fresh.select("key", "chunk_idx", "emb")

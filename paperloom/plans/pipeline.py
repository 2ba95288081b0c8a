"""The operators put together: reports to summaries with verdicts, reports and reference texts to training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS, TITLES
from ..functions.text import evidence_block, guided_query, normalize_text, safe_filename
from ..operators import align, samples
from ..operators.chunk import has_tokens, word_tokens
from ..operators.evidence import measured, within_budget
from ..operators.generate import extractive, generate_sections, qa_text, run_report, sample_documents
from ..operators.retrieve import embed_documents, hashed_embedder, pick_chunks
from ..operators.tokens import chunk_texts, joined_chunks


def chunked(docs: DataFrame, tokenizer=None) -> DataFrame:
    """(doc_id, texts array<string>) of (doc_id, text): windows over the tokens of the stand-in or of a tokenizer provider, normalised (as
    tokens joined by spaces are by themselves)."""
    cut = F.transform(chunk_texts(tokenizer)(normalize_text("text")), lambda t: normalize_text(t)) if tokenizer else joined_chunks(F.col("_tokens"))
    shown = docs.where(has_tokens("text"))
    rows = shown if tokenizer else shown.select("doc_id", word_tokens(normalize_text("text")).alias("_tokens"))
    return rows.select("doc_id", cut.alias("texts"))


def section_evidence(docs: DataFrame, hints: DataFrame | None = None, embedder=hashed_embedder, titles: tuple[str, ...] = TITLES, tokenizer=None, cache: DataFrame | None = None) -> DataFrame:
    """(doc_id, section_ord, section, blocks): chunks of each document that serve a section, diverse, under the section's header.

    ``hints`` (doc_id, hint) enrich the queries. A document stays one row from its text to its evidence: chunks, vectors and picks are
    arrays, so nothing is exchanged but hints and cached vectors. :func:`evidence_and_cache` also returns the new vectors.
    """
    return evidence_and_cache(docs, hints, embedder, titles, tokenizer, cache)[0]


def evidence_and_cache(docs: DataFrame, hints: DataFrame | None = None, embedder=hashed_embedder, titles: tuple[str, ...] = TITLES, tokenizer=None, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`section_evidence`, and the rows to append to the cache of vectors."""
    embedded, fresh = embed_documents(chunked(docs, tokenizer), cache, embedder)
    rows = embedded.join(hints.select("doc_id", "hint"), "doc_id", "left") if hints is not None else embedded.withColumn("hint", F.lit(None).cast("string"))
    queries = F.array(*(guided_query(F.lit(t), F.col("hint")) for t in titles))
    sections = rows.withColumn("_queries", queries).select("doc_id", "texts", F.posexplode(pick_chunks(embedder)(F.col("embs"), F.col("_queries"))).alias("_place", "_picks"))
    section = F.element_at(F.lit(list(titles)), F.col("_place") + 1)
    blocks = F.filter(F.transform("_picks", lambda i: evidence_block(section, F.get("texts", i), normal=True)), lambda b: b.isNotNull())
    return sections.select("doc_id", (F.col("_place") + 1).alias("section_ord"), section.alias("section"), blocks.alias("blocks")), fresh


def summarise(docs: DataFrame, hints: DataFrame | None = None, embedder=hashed_embedder, generator=extractive, retries: int = LIMITS.retries, tokenizer=None, cache: DataFrame | None = None) -> DataFrame:
    """A run report per document of (doc_id, text)."""
    evidence = section_evidence(docs, hints, embedder, tokenizer=tokenizer, cache=cache)
    clipped = evidence.withColumn("blocks", within_budget(measured(F.col("blocks"), normal=True)))
    return run_report(generate_sections(clipped, generator, retries), docs)


def training_samples(
    reports: DataFrame, seeds: DataFrame, order: str = "ord", embedder=hashed_embedder, tokenizer=None, ids=None, variants: int = LIMITS.variants, most: int = LIMITS.sequence
) -> DataFrame:
    """(doc_id, variant, messages, encoded, n_supervised): samples from retrieved evidence for every document with a reference text.

    The reference text is the answer and guides the queries. Retrieval runs once per document; the variants differ by the jitter
    of its evidence. ``ids`` turns a text into token ids; :func:`training_counts` tells what fell out and why.
    """
    ids = ids or (lambda c: F.transform(word_tokens(c), lambda t: F.length(t)))
    index = align.document_index(reports.select("doc_id", order), order)
    targets = align.seed_map(seeds.withColumn("target", normalize_text("target")).where("target <> ''"), index)
    texts = reports.select(order, normalize_text("full_text").alias("text"))
    docs = align.with_last(index.join(targets, "doc_id"), texts, order, ["text"]).select("doc_id", "text", "target")
    found = section_evidence(docs, docs.select("doc_id", F.col("target").alias("hint")), embedder, tokenizer=tokenizer)
    blocks = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("section_ord", "blocks"))), lambda x: x["blocks"]))
    joined = docs.drop("text").join(found.groupBy("doc_id").agg(blocks.alias("blocks")), "doc_id", "left")
    made = samples.evidence_samples(joined.withColumn("blocks", F.coalesce("blocks", F.array().cast("array<string>"))), variants=variants)
    return samples.encoded_chat(made, ids, most)


def training_counts(made: DataFrame, least: int = LIMITS.least_supervised) -> DataFrame:
    """(n_documents, missed, dropped, kept, least, mean, most): documents without evidence are missed, samples with too little to learn from
    dropped; the rest is over what is kept."""
    per = made.groupBy("doc_id").agg(F.count("n_supervised").alias("n"))
    docs = per.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("n") == 0).alias("missed"))
    n = F.when(F.col("n_supervised") >= least, F.col("n_supervised"))
    kept = made.agg(F.count_if(F.col("n_supervised") < least).alias("dropped"), F.count(n).alias("kept"), F.min(n).alias("least"), F.round(F.avg(n), 6).alias("mean"), F.max(n).alias("most"))
    return docs.join(F.broadcast(kept))


def qa_probe(docs: DataFrame, n: int = 2, tag: str = "probe", hints: DataFrame | None = None, seed: int = LIMITS.seed, **how) -> DataFrame:
    """(doc_id, name, text): summaries of ``n`` drawn documents with text, with their verdicts, under the names of their files."""
    drawn = sample_documents(docs.where(normalize_text("text") != ""), n, seed=seed)
    report = summarise(drawn, hints, retries=1, **how)
    name = F.concat(F.lit(f"{tag}_"), F.col("draw_no").cast("string"), F.lit("_"), safe_filename(F.col("doc_id").cast("string"), 80))
    text = qa_text(F.col("merged"), F.col("qc_reasons"), F.col("section_fail"))
    return report.join(drawn.select("doc_id", "draw_no"), "doc_id").select("doc_id", name.alias("name"), text.alias("text"))

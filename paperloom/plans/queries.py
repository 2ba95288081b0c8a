"""Queries of the document operators over the tables of a folder, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ASK, EVIDENCE_INTRO, LIMITS, QUALITY_TIP, SOURCE_HEAD, STYLE_EVIDENCE, STYLE_FULL, SYSTEM_FULL, TAXONOMY, TITLES
from ..functions.headings import looks_like_heading, match_section, normalize_heading
from ..functions.postprocess import cleaned_lines, rebuilt
from ..functions.quality import five_sections, qc_section, qc_summary
from ..functions.text import cache_key, evidence_block, guided_query, loose_key, merge_sections, normalize_text, safe_filename, strip_title_prefix, text, visible_length
from ..operators import align, chunk, convert, evidence, generate, report, retrieve, samples, sections, tokens
from ..session import table
from ..sources.files import stem, suffix
from . import pipeline


def _reports(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(s, d, "reports_sections").select(*columns)


def _lines(s: SparkSession, d: str) -> DataFrame:
    return sections.paragraphs(_reports(s, d, "ord", "full_text"), "ord", "full_text")


def _section_rows(s: SparkSession, d: str) -> DataFrame:
    """(ord, section_ord, section, text): the stored sections in canonical order, blank ones left out."""
    each = evidence.with_sections(_reports(s, d, "ord", "sections"))
    return each.select("ord", "section_ord", "section", normalize_text(F.coalesce(F.col("sections")[F.col("section")], F.lit(""))).alias("text")).where("text <> ''")


def _answers(s: SparkSession, d: str) -> DataFrame:
    answer = F.try_element_at(F.filter("messages", lambda m: m.role == "assistant"), F.lit(-1))["content"]
    return table(s, d, "sft_train").select("sample_id", text(answer).alias("answer"))


def _index(s: SparkSession, d: str, *columns) -> DataFrame:
    return align.document_index(_reports(s, d, "ord", "doc_id", *columns), "ord")


def _source() -> F.Column:
    return samples.source_text(F.col("full_text"), F.col("title"), F.col("sections"))


def _seeds(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "seeds").withColumn("target", normalize_text("target")).where("target <> ''")


def text_normalize(s, d):
    return _reports(s, d, "ord", "title", "full_text").select("ord", normalize_text("title").alias("title"), F.length(normalize_text("full_text")).cast("bigint").alias("n_chars"), F.md5(normalize_text("full_text")).alias("digest"))


def safe_names(s, d):
    return _reports(s, d, "ord", "title", "doc_id").select("ord", safe_filename("title", LIMITS.safe_name_chars).alias("name"), safe_filename("doc_id").alias("doc_name"))


def loose_keys(s, d):
    return _reports(s, d, "ord", "title", "doc_id").select("ord", loose_key("title").alias("title_key"), loose_key("doc_id").alias("doc_key"))


def visible_lengths(s, d):
    return _section_rows(s, d).select("ord", "section", visible_length("text").cast("bigint").alias("n_visible"))


def title_prefixes(s, d):
    rest = F.coalesce(*(F.when(F.col("section") == t, strip_title_prefix(F.concat("section", F.lit("： "), "text"), t)) for t in TITLES))
    return _section_rows(s, d).select("ord", "section", F.md5(rest).alias("digest"), F.length(rest).cast("bigint").alias("n_chars"))


def guided_queries(s, d):
    return _section_rows(s, d).select("ord", "section", F.md5(guided_query("section", "text")).alias("digest"))


def merged_sections(s, d):
    parts = {t: F.coalesce(F.col("sections")[t], F.lit("")) for t in TITLES}
    merged = merge_sections(parts)
    return _reports(s, d, "ord", "sections").select("ord", F.length(merged).cast("bigint").alias("n_chars"), F.md5(merged).alias("digest"))


def cache_keys(s, d):
    values = F.transform(F.lit(list(TITLES)), lambda t: F.coalesce(F.col("sections")[t], F.lit("")))
    return _reports(s, d, "ord", "doc_id", "sections").select("ord", cache_key(F.col("doc_id"), values, "stand-in").alias("key"))


def doc_title(s, d):
    return sections.text_records(_reports(s, d, "ord", "full_text"), "ord", "full_text").select("ord", "title")


def heading_match(s, d):
    rows = _lines(s, d).where(looks_like_heading("text"))
    return rows.select("ord", "pos", normalize_heading("text").alias("heading"), match_section("text").alias("section"))


def section_forward_fill(s, d):
    return sections.section_counts(_reports(s, d, "ord", "full_text"), "ord", "full_text")


def section_windows(s, d):
    """The same through windows, as for paragraphs that come as rows."""
    filled = sections.section_fill(_lines(s, d), "ord").where(~F.col("is_heading"))
    return filled.groupBy("ord", "section").agg(F.count(F.lit(1)).alias("n_paragraphs"), F.sum(F.length("text")).alias("n_chars"))


def section_text(s, d):
    records = sections.text_records(_reports(s, d, "ord", "full_text"), "ord", "full_text")
    return records.select("ord", "title", *(F.md5(F.col("sections")[t]).alias(f"section_{i}") for i, t in enumerate(TITLES, 1)), F.length("full_text").cast("bigint").alias("n_chars"))


def section_lengths(s, d):
    return sections.section_lengths(_reports(s, d, "ord", "sections"), "ord").withColumn("n_chars", F.col("n_chars").cast("bigint"))


def paragraph_chunks(s, d):
    rows = chunk.chunk_table(_reports(s, d, "ord", "full_text").withColumn("full_text", normalize_text("full_text")), "ord", "full_text")
    return rows.select("ord", "chunk_idx", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def token_chunks(s, d):
    rows = chunk.token_chunk_table(_reports(s, d, "ord", "full_text"), "ord", "full_text")
    return rows.select("ord", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.size("tokens").cast("bigint").alias("n_tokens"), F.md5("text").alias("digest"))


def prefix_dedup(s, d):
    rows = table(s, d, "documents").where("text is not null").select("doc_id", F.md5(F.substring("text", 1, LIMITS.dedup_prefix)).alias("head"))
    return chunk.keep_first(rows, F.col("head"), ["doc_id"]).select("doc_id")


def md5_dedup(s, d):
    rows = table(s, d, "documents").where("text is not null").select("doc_id", "source", F.md5("text").alias("digest"))
    return chunk.keep_first(rows, F.col("digest"), ["doc_id"], ["source"]).select("doc_id", "source")


def document_index(s, d):
    return _index(s, d, F.md5(_source()).alias("digest")).select("doc_id", "safe_doc_id", "doc_ord", "digest")


def seed_alignment(s, d):
    return align.align(_seeds(s, d), _index(s, d)).select("seed_stem", "doc_id", F.col("tier").cast("bigint").alias("tier"))


def unmatched_seeds(s, d):
    return align.unmatched_seeds(_seeds(s, d), _index(s, d, F.left(_source(), F.lit(1)).alias("source")))


def unmatched_docs(s, d):
    return align.unmatched_docs(_seeds(s, d), _index(s, d))


def seed_map(s, d):
    return align.seed_map(_seeds(s, d), _index(s, d)).select("doc_id", F.md5("target").alias("digest"))


def chat_samples(s, d):
    rows = samples.chat_samples(_reports(s, d, "ord", "doc_id", "title", "sections", "full_text"), table(s, d, "seeds"))
    return rows.select("meta.*", *(F.md5(F.col("messages")[i]["content"]).alias(c) for i, c in enumerate(("system", "user", "assistant"))))


def encoded_samples(s, d):
    """Token ids are token lengths here, so that SQL can state them too."""
    said = lambda *roles: F.array_join(F.transform(F.filter("messages", lambda m: m.role.isin(*roles)), lambda m: F.coalesce(m.content, F.lit(""))), "\n")
    ids = lambda c: F.transform(chunk.word_tokens(c), lambda t: F.length(t))
    rows = table(s, d, "sft_train").where("messages is not null").select("sample_id", ids(said("system", "user")).alias("prefix"), ids(said("assistant")).alias("answer"))
    done = rows.select("sample_id", samples.encode(F.col("prefix"), F.col("answer")).alias("encoded"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return done.select("sample_id", F.size("encoded.input_ids").cast("bigint").alias("n_ids"), total("encoded.input_ids").alias("sum_ids"), total("encoded.attention_mask").alias("n_seen"), samples.supervised(F.col("encoded.labels")).cast("bigint").alias("n_supervised"))


def train_valid_split(s, d):
    return samples.exact_split(table(s, d, "sft_train").select("sample_id"), "sample_id").select("sample_id", "split")


def cosine_topn(s, d):
    rows = table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("emb"))
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", "emb")
    return retrieve.cosine_topn(queries, rows, ["label"], "query_id", "vec_id").select("query_id", "vec_id", "sim", F.col("rank").cast("bigint").alias("rank"))


def mmr_rerank(s, d):
    rows = table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("emb"))
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", "emb")
    return retrieve.mmr_rerank(retrieve.cosine_topn(queries, rows, ["label"], "query_id", "vec_id"), ["query_id"], "vec_id")


def evidence_blocks(s, d):
    rows = _section_rows(s, d).withColumn("block", evidence_block(F.col("section"), F.col("text")))
    return evidence.distinct_blocks(rows, "ord", ["section_ord"]).select("ord", F.col("section_ord").cast("bigint").alias("section_ord"), F.md5("block").alias("digest"))


def budget_clip(s, d):
    rows = _section_rows(s, d).select("ord", "section_ord", F.col("text").alias("block"))
    done = evidence.budget_clip(rows, ["ord"], ["section_ord"])
    return done.select("ord", F.col("section_ord").cast("bigint").alias("section_ord"), F.col("n_tokens").cast("bigint").alias("n_tokens"), F.col("used").cast("bigint").alias("used"))


def evidence_variants(s, d):
    rows = _section_rows(s, d).select("ord", evidence_block(F.col("section"), F.col("text")).alias("block"))
    return evidence.jitter(rows, "ord").select("ord", F.col("variant").cast("bigint").alias("variant"), F.col("place").cast("bigint").alias("place"), F.md5("block").alias("digest"))


def evidence_prompts(s, d):
    """Training samples from stored sections as evidence and their merged text as answer: jitter, budget, prompt, labels, filter."""
    parts = {t: F.coalesce(F.col("sections")[t], F.lit("")) for t in TITLES}
    blocks = F.filter(F.array(*(evidence_block(F.lit(t), p) for t, p in parts.items())), lambda b: b.isNotNull())
    made = samples.evidence_samples(_reports(s, d, "ord", "sections").select("ord", blocks.alias("blocks"), merge_sections(parts).alias("target")), "ord").where("messages is not null")
    kept = samples.well_supervised(samples.encoded_chat(made, lambda c: F.transform(chunk.word_tokens(c), lambda t: F.length(t))))
    return kept.select("ord", F.col("variant").cast("bigint").alias("variant"), F.md5(F.col("messages")[1]["content"]).alias("digest"), F.col("n_supervised").cast("bigint").alias("n_supervised"))


def supervision(s, d):
    rows = table(s, d, "sft_train").where("messages is not null and size(messages) > 1").select("sample_id", "messages")
    encoded = samples.encoded_chat(rows, lambda c: F.transform(chunk.word_tokens(c), lambda t: F.length(t)))
    return samples.supervision_report(encoded)


def chat_texts(s, d):
    return table(s, d, "sft_train").where("messages is not null").select("sample_id", F.md5(tokens.chat_text(F.col("messages"), True)).alias("digest"))


def token_round_trip(s, d, vocabulary: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"):
    """Texts through the ids of a public vocabulary and back."""
    load = tokens.bpe(vocabulary)
    rows = table(s, d, "documents").where("text is not null").select("doc_id", tokens.encode_ids(load)(F.col("text")).alias("ids"))
    return rows.select("doc_id", F.md5(tokens.decode_ids(load)(F.col("ids"))).alias("digest"))


def training_samples(s, d):
    made = pipeline.training_samples(_reports(s, d, "ord", "doc_id", "full_text"), table(s, d, "seeds"))
    return made.where("n_supervised is not null").select("doc_id", "variant", F.md5(F.col("messages")[1]["content"]).alias("digest"), "n_supervised")


def training_counts(s, d):
    return pipeline.training_counts(pipeline.training_samples(_reports(s, d, "ord", "doc_id", "full_text"), table(s, d, "seeds")))


def qa_texts(s, d):
    """Stored sections as if they had just been generated, with the verdicts below them."""
    own = {t: normalize_text(F.coalesce(F.col("sections")[t], F.lit(""))) for t in TITLES}
    rows = _reports(s, d, "ord", "sections").select("ord", merge_sections(own).alias("merged"), F.create_map(*(x for t, c in own.items() for x in (F.lit(t), qc_section(c)))).alias("fails"))
    judged = rows.withColumn("reasons", qc_summary("merged"))
    return judged.select("ord", F.md5(generate.qa_text(F.col("merged"), F.col("reasons"), F.col("fails"))).alias("digest"))


def qa_probe(s, d):
    docs = _reports(s, d, F.col("ord").cast("string").alias("doc_id"), F.col("full_text").alias("text"))
    return pipeline.qa_probe(docs)


def qc_sections(s, d):
    return _section_rows(s, d).select("ord", "section", F.array_join(qc_section("text"), "|").alias("reasons"))


def qc_answers(s, d):
    rows = _answers(s, d).withColumn("parts", five_sections("answer"))
    reasons = qc_summary("answer", F.col("parts"))
    return rows.select("sample_id", F.array_join(reasons, "|").alias("reasons"), (F.size(reasons) == 0).alias("ok"))


def split_answers(s, d):
    rows = _answers(s, d).withColumn("parts", five_sections("answer")).where("parts is not null")
    return rows.select("sample_id", *(F.md5(F.col("parts")[t]).alias(f"section_{i}") for i, t in enumerate(TITLES, 1)))


def cleaned_answers(s, d):
    rows = _answers(s, d).withColumn("lines", cleaned_lines("answer"))
    return rows.select("sample_id", F.md5(rebuilt(F.col("lines"))).alias("digest"))


def run_pass_rate(s, d):
    return report.pass_rate(table(s, d, "run_report"))


def run_reasons(s, d):
    return report.reason_counts(table(s, d, "run_report"))


def run_section_failures(s, d):
    rows = table(s, d, "run_report").select(F.explode(F.map_filter("section_fail", lambda _, v: F.size(v) > 0)).alias("section", "reasons"))
    return rows.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("reasons")).alias("n_reasons"))


def file_kinds(s, d):
    rows = table(s, d, "source_files").select(suffix("path").alias("kind"), "length")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("length"), F.lit(0)) == 0).alias("n_empty"))


def pending_conversions(s, d):
    """Files to convert: those whose stem has no newer word-processor file."""
    files = table(s, d, "source_files").select("path", stem("path").alias("dst"), suffix("path").alias("kind"), "modificationtime")
    made = files.where("kind = '.docx'").select("dst", F.col("modificationtime").alias("modificationTime"))
    waiting = files.where("kind in ('.doc', '.pdf')").withColumnRenamed("modificationtime", "modificationTime")
    return convert.pending(waiting, made).select("path", "dst").distinct()


def summaries(s, d):
    docs = _reports(s, d, F.col("ord").cast("string").alias("doc_id"), F.col("full_text").alias("text"))
    rows = pipeline.summarise(docs)
    return rows.select("doc_id", "qc_ok", F.array_join("qc_reasons", "|").alias("reasons"), F.length("text").alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        section_text, section_forward_fill, doc_title, heading_match, section_lengths, text_normalize, safe_names, loose_keys, visible_lengths, title_prefixes,
        guided_queries, merged_sections, cache_keys, paragraph_chunks, token_chunks, prefix_dedup, md5_dedup, document_index, seed_alignment, unmatched_seeds,
        section_windows, unmatched_docs, seed_map, chat_samples, chat_texts, encoded_samples, supervision, evidence_prompts, training_samples, training_counts, token_round_trip, qa_texts, qa_probe, train_valid_split, cosine_topn, mmr_rerank, evidence_blocks, budget_clip, evidence_variants,
        qc_sections, qc_answers, split_answers, cleaned_answers, run_pass_rate, run_reasons, run_section_failures, file_kinds, pending_conversions, summaries,
    )
}

# ---------------------------------------------------------------------------------------------------------------- SQL

_WS = r"[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]"
_ANY = "|".join(TITLES)
_TITLE_LIST = "[" + ", ".join(f"'{t}'" for t in TITLES) + "]"
_CJK = r"\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+\\z', '', 'g')"


def _norm(x: str) -> str:
    spaced = f"regexp_replace(replace(replace(coalesce({x}, ''), '　', ' '), chr(9), ' '), ' {{2,}}', ' ', 'g')"
    return _strip(f"regexp_replace({spaced}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _safe(x: str) -> str:
    cleaned = f"""regexp_replace({_norm(x)}, '[\\\\/:*?"<>|]', '_', 'g')"""
    stripped = _strip(f"regexp_replace({cleaned}, '{_WS}+', ' ', 'g')")
    return f"regexp_replace({stripped}, '[ .]+\\z', '')"


def _loose(x: str) -> str:
    return f"lower(regexp_replace({_norm(x)}, '[^\\p{{L}}\\p{{N}}_]+', '', 'g'))"


def _visible(x: str) -> str:
    return f"length(regexp_replace({_norm(x)}, '{_WS}+', '', 'g'))"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(regexp_replace(coalesce({x}, ''), '([{_CJK}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\p{{Z}}\\s]')"


def _heading(x: str) -> str:
    bare = f"regexp_replace(coalesce({x}, ''), '{_WS}+', '', 'g')"
    unnumbered = f"regexp_replace({bare}, '^第?[零一二三四五六七八九十百千\\p{{Nd}}]+[章节部分]?[、.．)）\\-]*', '')"
    return f"regexp_replace({unnumbered}, '[：:；;，,。.]+\\z', '')"


_MATCH = (
    f"CASE WHEN h IN ({', '.join(repr(t) for t in TITLES)}) THEN h WHEN h = '' THEN NULL "
    + " ".join(f"WHEN regexp_matches(h, '{'|'.join(aliases)}') THEN '{name}'" for name, aliases in TAXONOMY)
    + " END"
)
_LINES = f"""
  cut AS (SELECT ord, regexp_split_to_array(coalesce(full_text, ''), '\\r\\n|\\r|\\n') AS a FROM reports_sections),
  raw AS (SELECT ord, unnest(range(len(a))) AS pos, unnest(a) AS line FROM cut),
  lines AS (SELECT ord, pos, {_norm('line')} AS text FROM raw WHERE {_norm('line')} <> '')"""
_FILLED = f"""{_LINES},
  marked AS (SELECT *, length({_strip('text')}) <= {LIMITS.heading_chars} AS is_heading, {_heading('text')} AS h FROM lines),
  opened AS (SELECT *, CASE WHEN is_heading THEN {_MATCH} END AS opened FROM marked),
  filled AS (SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY ord ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM opened)"""
_SECTIONS = f"""
  each AS (SELECT ord, sections, unnest({_TITLE_LIST}) AS section, unnest([1, 2, 3, 4, 5]) AS section_ord FROM reports_sections),
  secs AS (SELECT ord, section, section_ord, {_norm("element_at(sections, section)[1]")} AS text FROM each WHERE {_norm("element_at(sections, section)[1]")} <> '')"""
_ANSWERS = "answers AS (SELECT sample_id, coalesce(list_filter(messages, lambda m: m.role = 'assistant')[-1].content, '') AS answer FROM sft_train)"
_SOURCE = f"""
  built AS (SELECT ord, doc_id, {_norm('full_text')} AS body,
      list_concat(CASE WHEN {_norm('title')} <> '' THEN ['标题：' || {_norm('title')}] ELSE [] END,
        coalesce(list_filter(list_transform(map_entries(sections), lambda e: CASE WHEN {_norm('e.value')} <> '' THEN e.key || '：' || chr(10) || {_norm('e.value')} END), lambda x: x IS NOT NULL), [])) AS parts
    FROM reports_sections),
  sourced AS (SELECT ord, {_norm('doc_id')} AS doc_id, CASE WHEN body <> '' THEN body ELSE {_strip("coalesce(array_to_string(parts, chr(10) || chr(10)), '')")} END AS source FROM built),
  idx AS (SELECT doc_id, min(ord) AS doc_ord, arg_max(source, ord) AS source, {_safe('doc_id')} AS safe_doc_id FROM sourced WHERE doc_id <> '' GROUP BY doc_id)"""
_ALIGNED = f"""{_SOURCE},
  sd AS (SELECT seed_stem, seed_path, {_norm('target')} AS target FROM seeds WHERE {_norm('target')} <> ''),
  stems AS (SELECT DISTINCT seed_stem FROM sd WHERE seed_stem IS NOT NULL),
  sk AS (SELECT seed_stem, 1 AS tier, {_norm('seed_stem')} AS k FROM stems UNION ALL SELECT seed_stem, 2, {_safe('seed_stem')} FROM stems
         UNION ALL SELECT seed_stem, 3, {_loose('seed_stem')} FROM stems UNION ALL SELECT seed_stem, 4, {_loose('seed_stem')} FROM stems),
  dk AS (SELECT doc_id, doc_ord, 1 AS tier, doc_id AS k FROM idx UNION ALL SELECT doc_id, doc_ord, 2, safe_doc_id FROM idx
         UNION ALL SELECT doc_id, doc_ord, 3, {_loose('doc_id')} FROM idx UNION ALL SELECT doc_id, doc_ord, 4, {_loose('safe_doc_id')} FROM idx),
  hits AS (SELECT seed_stem, sk.tier, arg_min(doc_id, doc_ord) AS doc_id FROM sk JOIN dk ON sk.tier = dk.tier AND sk.k = dk.k AND sk.k <> '' GROUP BY ALL),
  aligned AS (SELECT seed_stem, arg_min(doc_id, tier) AS doc_id, min(tier) AS tier FROM hits GROUP BY seed_stem)"""
_PARTS = f"""{_ANSWERS},
  body AS (SELECT sample_id, {_norm('answer')} AS t FROM answers),
  pieces AS (SELECT sample_id, t, regexp_extract_all(t, '({_ANY}){_WS}*[:：]?', 1) AS names, list_transform(regexp_split_to_array(t, '(?:{_ANY}){_WS}*[:：]?')[2:], lambda x: {_norm('x')}) AS bodies FROM body),
  found AS (SELECT sample_id, t, CASE WHEN len(names) >= 5 THEN list_transform({_TITLE_LIST}, lambda k: coalesce(bodies[len(names) + 1 - nullif(list_position(list_reverse(names), k), 0)], '')) END AS raw FROM pieces),
  five AS (SELECT sample_id, t, CASE WHEN len(list_filter(raw, lambda x: x = '')) = 0 THEN raw END AS parts FROM found)"""
_QUOTES = """[“”"《》]"""


def _section_reasons(x: str) -> str:
    return f"""CASE WHEN {x} = '' THEN '空段落' ELSE array_to_string(list_filter([
        CASE WHEN regexp_matches({x}, '[A-Za-z0-9]') THEN '包含英文或数字（禁用）' END, CASE WHEN {_visible(x)} > {LIMITS.section_limit} THEN '本段超过三百字' END,
        CASE WHEN regexp_matches({x}, '{_QUOTES}') THEN '包含引号或书名号，疑似引用' END], lambda r: r IS NOT NULL), '|') END"""


_TOO_LONG = ", ".join(f"CASE WHEN {_visible(f'parts[{i}]')} > {LIMITS.section_limit} THEN '{t} 超过三百字' END" for i, t in enumerate(TITLES, 1))
_QC = f"""CASE WHEN t = '' THEN '空输出' WHEN parts IS NULL THEN (CASE WHEN regexp_matches(t, '[A-Za-z0-9]') THEN '包含英文或数字（禁用）|' ELSE '' END) || '未按五段结构输出或标题缺失'
    ELSE array_to_string(list_filter([CASE WHEN regexp_matches(t, '[A-Za-z0-9]') THEN '包含英文或数字（禁用）' END, CASE WHEN {_visible('t')} > {LIMITS.total_limit} THEN '总字数超限' END,
      {_TOO_LONG}, CASE WHEN regexp_matches(t, '{_QUOTES}') THEN '包含引号或书名号，疑似引用' END], lambda r: r IS NOT NULL), '|') END"""


def _draw(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)}, '{LIMITS.seed}')), 1, 8))::BIGINT / 4294967296.0)"


_SIZE, _STEP = LIMITS.chunk_tokens, LIMITS.chunk_tokens - LIMITS.token_overlap


def _packed(source: str, key: str) -> str:
    """The fold over paragraphs of ``source`` (key, body) as a recursion; ``packed`` has (key, chunks) before repeated ones go."""
    body, size, overlap = _norm("body"), LIMITS.chunk_chars, LIMITS.chunk_overlap
    cut = f"CASE WHEN contains(body, chr(10) || chr(10)) THEN string_split(body, chr(10) || chr(10)) ELSE string_split(body, chr(10)) END"
    return f"""
  paras AS (SELECT {key} AS k, list_filter(list_transform({cut}, lambda x: {_strip('x')}), lambda x: x <> '') AS ps FROM {source}),
  fold AS (
    SELECT k, ps, 0 AS i, []::VARCHAR[] AS done, NULL::VARCHAR AS buf, 0::BIGINT AS n FROM paras
    UNION ALL
    SELECT k, ps, i + 1,
      CASE WHEN fits THEN done WHEN length(p) > {size} THEN list_concat(closed, list_transform(range(0, length(p), {size}), lambda a: {_strip(f"substr(p, a::BIGINT + 1, {size})")})) ELSE closed END,
      CASE WHEN fits THEN coalesce(buf || chr(10) || chr(10), '') || p WHEN length(p) > {size} THEN NULL WHEN tail <> '' THEN tail || chr(10) || chr(10) || p ELSE p END,
      CASE WHEN fits THEN n + length(p) + 2 WHEN length(p) > {size} THEN 0 WHEN tail <> '' THEN length(tail) + length(p) + 2 ELSE length(p) END
    FROM (SELECT *, coalesce({_strip(f"right(closed[-1], {overlap})")}, '') AS tail FROM
      (SELECT *, ps[i + 1] AS p, length(ps[i + 1]) <= {size} AND n + length(ps[i + 1]) + 2 <= {size} AS fits, CASE WHEN buf IS NULL THEN done ELSE list_append(done, {_strip('buf')}) END AS closed
       FROM fold WHERE i < len(ps)))),
  packed AS (SELECT k, CASE WHEN buf IS NULL THEN done ELSE list_append(done, {_strip('buf')}) END AS chunks FROM fold WHERE i = len(ps)),
  spread AS (SELECT k, unnest(chunks) AS c, unnest(range(len(chunks))) AS nth FROM packed),
  firsts AS (SELECT k, nth, c FROM spread QUALIFY row_number() OVER (PARTITION BY k, left(c, {LIMITS.dedup_prefix}) ORDER BY nth) = 1)"""


def _cleaned() -> str:
    """The replacements one after the other; look-ahead is spelt out with groups, and word ends with the characters around them."""
    ws, stops, t = _WS, rf"(?:[，,。；;、]|{_WS})", _norm("answer")
    letter = r"\p{L}\p{N}_"
    far = r"[^\t-\r\x{1c}-\x{1f}\x{85}\p{Z}\x{4e00}-\x{9fa5}]+"
    rules = [
        (rf"({_ANY}){ws}*[:：]{{2,}}{ws}*", r"\1："), (r"[:：]{2,}", "："), (rf"(研究问题[:：]{ws}*)(?:研究发现|发现|在于){ws}*", r"\1"), (rf"(研究效果[:：]{ws}*)方面{ws}*", r"\1"), (rf"([：:]){ws}*[，,]{ws}*", r"\1"),
        (f"https?://{far}", ""), (rf"www\.{far}", ""), (rf"(^|[^{letter}])[a-zA-Z0-9\-]+\.(?:com|cn|net|org|edu|gov|info|io|co)(?:\.[a-zA-Z]{{2}})?($|[^{letter}])", r"\1\2"),
    ]
    for name in TITLES:
        rules += [(rf"({name}[:：]{ws}*)方面({stops})", r"\1\2"), (rf"({name}[:：]{ws}*)方面{ws}+", r"\1")]
    for pattern, to in rules:
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return t


_SHAPE = f"(?s)^({_ANY})[:：]{_WS}*(.*)\\z"
_CLEANED = f"""{_ANSWERS},
  ruled AS (SELECT sample_id, {_cleaned()} AS t FROM answers),
  each_line AS (SELECT sample_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS a FROM ruled),
  shaped AS (SELECT sample_id, array_to_string(list_transform(a, lambda x: CASE WHEN regexp_matches(x, '^(?:{_ANY})[:：]') THEN regexp_extract(x, '{_SHAPE}', 1) || '：' ||
      CASE WHEN regexp_matches({_strip(f"regexp_extract(x, '{_SHAPE}', 2)")}, '^方面(?:[，,。；;、]|{_WS})') THEN regexp_replace({_strip(f"regexp_extract(x, '{_SHAPE}', 2)")}, '^方面{_WS}*', '') ELSE {_strip(f"regexp_extract(x, '{_SHAPE}', 2)")} END
      ELSE x END), chr(10)) AS lines FROM each_line),
  cut AS (SELECT sample_id, lines, regexp_extract_all({_norm('lines')}, '({_ANY})[:：]', 1) AS names, list_transform(regexp_split_to_array({_norm('lines')}, '(?:{_ANY})[:：]')[2:], lambda x: {_norm('x')}) AS bodies FROM shaped),
  told AS (SELECT sample_id, CASE WHEN len(names) >= 5
      THEN array_to_string(list_transform({_TITLE_LIST}, lambda k: k || '：' || regexp_replace(coalesce(bodies[len(names) + 1 - nullif(list_position(list_reverse(names), k), 0)], ''), '{_WS}*\n+{_WS}*', ' ', 'g')), chr(10))
      ELSE regexp_replace(lines, '{_WS}*\n+{_WS}*', ' ', 'g') END AS x FROM cut)"""

_MERGED = _norm("array_to_string(list_transform(" + _TITLE_LIST + ", lambda t: t || '：' || " + _norm("element_at(sections, t)[1]") + "), chr(10))")
_PROMPT = f"'{STYLE_EVIDENCE}' || chr(10) || chr(10) || '{EVIDENCE_INTRO.strip()}' || chr(10) || chr(10)"

SQL: dict[str, str] = {
    "paragraph_chunks": f"""WITH RECURSIVE bodies AS (SELECT ord, {_norm('full_text')} AS body FROM reports_sections), {_packed('bodies', 'ord')}
        SELECT k AS ord, (row_number() OVER (PARTITION BY k ORDER BY nth) - 1)::INTEGER AS chunk_idx, length(c)::INTEGER AS n_chars, md5(c) AS digest FROM firsts""",
    "chat_samples": f"""WITH RECURSIVE {_ALIGNED}, last AS (SELECT doc_id AS id, arg_max(title, ord) AS title FROM (SELECT ord, {_norm('doc_id')} AS doc_id, {_norm('title')} AS title FROM reports_sections) GROUP BY doc_id),
        bodies AS (SELECT doc_id, source AS body FROM idx WHERE source <> '' AND doc_id IN (SELECT doc_id FROM aligned)), {_packed('bodies', 'doc_id')},
        whole AS (SELECT k, count(*) AS n, {_strip("string_agg(c, chr(10) || chr(10) ORDER BY nth)")} AS merged FROM firsts GROUP BY k)
        SELECT idx.doc_id, safe_doc_id, sd.seed_stem, seed_path, last.title, n::INTEGER AS n_chunks, length(merged)::INTEGER AS source_chars, length(target)::INTEGER AS target_chars, md5('{SYSTEM_FULL}') AS system,
          md5('{STYLE_FULL}' || chr(10) || chr(10) || '{SOURCE_HEAD.strip()}' || chr(10) || merged || chr(10) || chr(10) || '{ASK}') AS "user", md5(target) AS assistant
        FROM sd JOIN aligned a ON a.seed_stem = sd.seed_stem JOIN idx ON idx.doc_id = a.doc_id JOIN whole ON k = idx.doc_id JOIN last ON id = idx.doc_id""",
    "cleaned_answers": f"WITH {_CLEANED} SELECT sample_id, md5({_norm('x')}) AS digest FROM told",
    "chat_texts": """SELECT sample_id, md5(array_to_string(list_transform(messages, lambda m: '<|im_start|>' || m.role || chr(10) || coalesce(m.content, '') || '<|im_end|>' || chr(10)), '') || '<|im_start|>assistant' || chr(10)) AS digest
        FROM sft_train WHERE messages IS NOT NULL""",
    "token_round_trip": "SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL",
    "supervision": f"""WITH n AS (SELECT least(len({_tokens("messages[-1].content")}), {LIMITS.sequence}) AS n FROM sft_train WHERE len(messages) > 1)
        SELECT count(*) FILTER (WHERE n < {LIMITS.least_supervised}) AS dropped, count(*) FILTER (WHERE n >= {LIMITS.least_supervised}) AS kept, min(n)::INTEGER AS least, round(avg(n), 6) AS mean, max(n)::INTEGER AS most FROM n""",
    "evidence_prompts": f"""WITH {_SECTIONS}, b AS (SELECT DISTINCT ord, '【' || section || '证据】' || chr(10) || {_norm('text')} AS block FROM secs),
        v AS (SELECT ord, block, unnest(range({LIMITS.variants})) AS variant FROM b),
        k AS (SELECT * FROM v WHERE {_draw('ord::VARCHAR', 'variant::VARCHAR', 'md5(block)', "'drop'")} > {LIMITS.jitter_drop}),
        r AS (SELECT *, row_number() OVER (PARTITION BY ord, variant ORDER BY {_draw('ord::VARCHAR', 'variant::VARCHAR', 'md5(block)', "'order'")}, block) AS place FROM k),
        c AS (SELECT ord, variant, place, CASE WHEN length(block) > {LIMITS.block_chars + LIMITS.block_slack} THEN left(block, {LIMITS.block_chars}) || '…' ELSE block END AS block FROM r WHERE place <= {LIMITS.jitter_most}),
        u AS (SELECT *, sum(len({_tokens('block')})) OVER (PARTITION BY ord, variant ORDER BY place) AS used FROM c),
        e AS (SELECT ord, variant, string_agg(block, chr(10) || chr(10) ORDER BY place) AS evidence FROM u WHERE used <= {LIMITS.budget_tokens} GROUP BY ord, variant),
        t AS (SELECT ord, {_MERGED} AS target FROM reports_sections)
        SELECT ord, variant, md5({_PROMPT} || evidence || CASE WHEN {_draw('ord::VARCHAR', 'variant::VARCHAR', "'tip'")} < {LIMITS.tip_share} THEN chr(10) || chr(10) || '{QUALITY_TIP.strip()}' ELSE '' END || chr(10) || chr(10) || '{ASK}') AS digest,
          least(len({_tokens('target')}), {LIMITS.sequence})::BIGINT AS n_supervised FROM e JOIN t USING (ord) WHERE len({_tokens('target')}) >= {LIMITS.least_supervised}""",
    "qa_texts": f"""WITH s AS (SELECT ord, {", ".join(f"{_norm(f"element_at(sections, '{t}')[1]")} AS s{i}" for i, t in enumerate(TITLES, 1))} FROM reports_sections),
        r AS (SELECT *, {", ".join(f"{_section_reasons(f's{i}')} AS r{i}" for i in range(1, 6))}, {_norm(" || chr(10) || ".join(f"'{t}：' || s{i}" for i, t in enumerate(TITLES, 1)))} AS t FROM s),
        pieces AS (SELECT *, regexp_extract_all(t, '({_ANY}){_WS}*[:：]?', 1) AS names, list_transform(regexp_split_to_array(t, '(?:{_ANY}){_WS}*[:：]?')[2:], lambda x: {_norm('x')}) AS bodies FROM r),
        found AS (SELECT *, CASE WHEN len(names) >= 5 THEN list_transform({_TITLE_LIST}, lambda k: coalesce(bodies[len(names) + 1 - nullif(list_position(list_reverse(names), k), 0)], '')) END AS raw FROM pieces),
        five AS (SELECT *, CASE WHEN len(list_filter(raw, lambda x: x = '')) = 0 THEN raw END AS parts FROM found),
        q AS (SELECT *, {_QC} AS reasons FROM five)
        SELECT ord, md5(t || chr(10) || chr(10) || CASE WHEN reasons = '' THEN '[QC_OK]' ELSE '[QC_FAIL] ' || replace(reasons, '|', '；') END || chr(10) ||
          {" || chr(10) || ".join(f"CASE WHEN r{i} = '' THEN '{t}=>OK' ELSE '{t}=>FAIL：' || replace(r{i}, '|', '；') END" for i, t in enumerate(TITLES, 1))}) AS digest FROM q""",
    "section_windows": f"WITH {_FILLED} SELECT ord, section, count(*) AS n_paragraphs, sum(length(text))::BIGINT AS n_chars FROM filled WHERE NOT is_heading GROUP BY ord, section",
    "text_normalize": f"SELECT ord, {_norm('title')} AS title, length({_norm('full_text')}) AS n_chars, md5({_norm('full_text')}) AS digest FROM reports_sections",
    "safe_names": f"SELECT ord, left({_safe('title')}, {LIMITS.safe_name_chars}) AS name, {_safe('doc_id')} AS doc_name FROM reports_sections",
    "loose_keys": f"SELECT ord, {_loose('title')} AS title_key, {_loose('doc_id')} AS doc_key FROM reports_sections",
    "visible_lengths": f"WITH {_SECTIONS} SELECT ord, section, {_visible('text')} AS n_visible FROM secs",
    "title_prefixes": f"""WITH {_SECTIONS}, r AS (SELECT ord, section, regexp_replace({_norm("section || '： ' || text")}, '^{_WS}*(?:{"|".join(TITLES)}){_WS}*[:：]?{_WS}*', '') AS x FROM secs)
        SELECT ord, section, md5(x) AS digest, length(x) AS n_chars FROM r""",
    "guided_queries": f"WITH {_SECTIONS} SELECT ord, section, md5(left({_norm('section || chr(10) || text')}, {LIMITS.query_chars})) AS digest FROM secs",
    "merged_sections": f"""WITH m AS (SELECT ord, {_norm("array_to_string(list_transform(" + _TITLE_LIST + ", lambda t: t || '：' || " + _norm("element_at(sections, t)[1]") + "), chr(10))")} AS x FROM reports_sections)
        SELECT ord, length(x) AS n_chars, md5(x) AS digest FROM m""",
    "cache_keys": f"""SELECT ord, md5(concat_ws('||', coalesce(doc_id, ''), md5(array_to_string(list_transform({_TITLE_LIST}, lambda t: coalesce(element_at(sections, t)[1], '')), '')), 'stand-in', '{LIMITS.chunk_tokens}', '{LIMITS.token_overlap}')) AS key
        FROM reports_sections""",
    "doc_title": f"WITH {_LINES} SELECT ord, coalesce(arg_min(text, pos) FILTER (WHERE length(text) <= {LIMITS.title_chars}), '') AS title FROM lines GROUP BY ord",
    "heading_match": f"WITH {_FILLED} SELECT ord, pos::INTEGER AS pos, h AS heading, opened AS section FROM filled WHERE is_heading",
    "section_forward_fill": f"WITH {_FILLED} SELECT ord, section, count(*) AS n_paragraphs, sum(length(text))::BIGINT AS n_chars FROM filled WHERE NOT is_heading GROUP BY ord, section",
    "section_text": f"""WITH {_FILLED} SELECT ord, coalesce(arg_min(text, pos) FILTER (WHERE length(text) <= {LIMITS.title_chars}), '') AS title,
        {", ".join(f"md5(coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE section = '{t}' AND NOT is_heading), '')) AS section_{i}" for i, t in enumerate(TITLES, 1))},
        length(string_agg(text, chr(10) ORDER BY pos)) AS n_chars FROM filled GROUP BY ord""",
    "section_lengths": f"""WITH each AS (SELECT ord, sections, unnest({_TITLE_LIST}) AS section FROM reports_sections) SELECT ord, section, length(coalesce(element_at(sections, section)[1], '')) AS n_chars FROM each""",
    "token_chunks": f"""WITH t AS (SELECT ord, {_tokens('full_text')} AS a FROM reports_sections), n AS (SELECT ord, a, greatest(0, ceil((len(a) - {_SIZE}) / {_STEP}.0))::BIGINT AS last FROM t WHERE len(a) > 0),
        c AS (SELECT ord, a, unnest(range(last + 1)) AS i FROM n) SELECT ord, i AS chunk_idx, len(a[i * {_STEP} + 1 : i * {_STEP} + {_SIZE}]) AS n_tokens, md5(array_to_string(a[i * {_STEP} + 1 : i * {_STEP} + {_SIZE}], ' ')) AS digest FROM c""",
    "prefix_dedup": f"SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY left(text, {LIMITS.dedup_prefix})",
    "md5_dedup": "SELECT min(doc_id) AS doc_id, source FROM documents WHERE text IS NOT NULL GROUP BY source, text",
    "document_index": f"WITH {_SOURCE} SELECT doc_id, safe_doc_id, doc_ord, md5(source) AS digest FROM idx",
    "seed_alignment": f"WITH {_ALIGNED} SELECT seed_stem, doc_id, tier::BIGINT AS tier FROM aligned",
    "unmatched_seeds": f"""WITH {_ALIGNED} SELECT seed_stem, seed_path, NULL::VARCHAR AS reason FROM sd WHERE NOT EXISTS (SELECT 1 FROM aligned a WHERE a.seed_stem = sd.seed_stem)
        UNION ALL SELECT sd.seed_stem, seed_path, 'empty_full_text' FROM sd JOIN aligned a ON a.seed_stem = sd.seed_stem JOIN idx ON idx.doc_id = a.doc_id WHERE source = ''""",
    "unmatched_docs": f"WITH {_ALIGNED} SELECT doc_id, safe_doc_id FROM idx WHERE doc_id NOT IN (SELECT doc_id FROM aligned)",
    "seed_map": f"WITH {_ALIGNED} SELECT a.doc_id, md5(arg_max(target, row(seed_path, target))) AS digest FROM sd JOIN aligned a ON a.seed_stem = sd.seed_stem GROUP BY a.doc_id",
    "encoded_samples": f"""WITH m AS (SELECT sample_id, array_to_string(list_transform(list_filter(messages, lambda x: x.role IN ('system', 'user')), lambda x: coalesce(x.content, '')), chr(10)) AS p,
          array_to_string(list_transform(list_filter(messages, lambda x: x.role = 'assistant'), lambda x: coalesce(x.content, '')), chr(10)) AS a FROM sft_train WHERE messages IS NOT NULL),
        t AS (SELECT sample_id, list_transform({_tokens('p')}, lambda x: length(x)) AS p, list_transform({_tokens('a')}, lambda x: length(x)) AS a FROM m),
        k AS (SELECT sample_id, list_concat(p, a) AS ids, len(a) AS na, greatest(len(p) + len(a) - {LIMITS.sequence}, 0) AS cut FROM t)
        SELECT sample_id, {LIMITS.sequence}::BIGINT AS n_ids, coalesce(list_sum(ids[cut + 1 :]), 0)::BIGINT AS sum_ids, least(len(ids), {LIMITS.sequence})::BIGINT AS n_seen, least(na, {LIMITS.sequence})::BIGINT AS n_supervised FROM k""",
    "train_valid_split": f"""WITH r AS (SELECT sample_id, row_number() OVER (ORDER BY md5(concat_ws('|', sample_id::VARCHAR, '{LIMITS.seed}')), sample_id) AS n, count(*) OVER () AS total FROM sft_train)
        SELECT sample_id, CASE WHEN n <= greatest(1, floor(total * {LIMITS.valid_ratio})) THEN 'valid' ELSE 'train' END AS split FROM r""",
    "cosine_topn": f"""WITH p AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS sim FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM p) SELECT * FROM r WHERE rank <= {LIMITS.top_n}""",
    "mmr_rerank": f"""WITH RECURSIVE s AS (SELECT q.vec_id AS query_id, c.vec_id, c.embedding::DOUBLE[] AS e, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS sim
          FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 50 = 0),
        t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s), p AS (SELECT * FROM t WHERE rank <= {LIMITS.top_n}),
        l AS (SELECT a.query_id, a.vec_id, b.vec_id AS other, list_inner_product(a.e, b.e) AS likeness FROM p a JOIN p b ON a.query_id = b.query_id),
        sel AS (SELECT query_id, 1 AS pick, vec_id, sim, [vec_id] AS chosen FROM p WHERE rank = 1
          UNION ALL
          SELECT query_id, pick + 1, vec_id, sim, list_append(chosen, vec_id) FROM (
            SELECT sel.query_id, sel.pick, p.vec_id, p.sim, sel.chosen,
              row_number() OVER (PARTITION BY sel.query_id ORDER BY {LIMITS.mmr_lambda} * p.sim - {1 - LIMITS.mmr_lambda} * max(l.likeness) DESC, p.rank) AS n
            FROM sel JOIN p ON p.query_id = sel.query_id AND NOT list_contains(sel.chosen, p.vec_id) JOIN l ON l.query_id = p.query_id AND l.vec_id = p.vec_id AND list_contains(sel.chosen, l.other)
            WHERE sel.pick < {LIMITS.mmr_k} GROUP BY sel.query_id, sel.pick, p.vec_id, p.sim, p.rank, sel.chosen) WHERE n = 1)
        SELECT query_id, vec_id, sim, pick FROM sel""",
    "evidence_blocks": f"""WITH {_SECTIONS}, b AS (SELECT ord, section_ord, '【' || section || '证据】' || chr(10) || {_norm('text')} AS block FROM secs)
        SELECT ord, min(section_ord)::BIGINT AS section_ord, md5(block) AS digest FROM b GROUP BY ord, block""",
    "budget_clip": f"""WITH {_SECTIONS}, c AS (SELECT ord, section_ord, CASE WHEN length(text) > {LIMITS.block_chars + LIMITS.block_slack} THEN left(text, {LIMITS.block_chars}) || '…' ELSE text END AS block FROM secs),
        n AS (SELECT ord, section_ord, len({_tokens('block')}) AS n_tokens FROM c), u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY ord ORDER BY section_ord) AS used FROM n)
        SELECT ord, section_ord::BIGINT AS section_ord, n_tokens::BIGINT AS n_tokens, used::BIGINT AS used FROM u WHERE used <= {LIMITS.budget_tokens}""",
    "evidence_variants": f"""WITH {_SECTIONS}, b AS (SELECT ord, '【' || section || '证据】' || chr(10) || {_norm('text')} AS block FROM secs),
        v AS (SELECT ord, block, unnest(range({LIMITS.variants})) AS variant FROM b),
        k AS (SELECT * FROM v WHERE {_draw('ord::VARCHAR', 'variant::VARCHAR', 'md5(block)', "'drop'")} > {LIMITS.jitter_drop}),
        r AS (SELECT *, row_number() OVER (PARTITION BY ord, variant ORDER BY {_draw('ord::VARCHAR', 'variant::VARCHAR', 'md5(block)', "'order'")}, block) AS place FROM k)
        SELECT ord, variant, place, md5(block) AS digest FROM r WHERE place <= {LIMITS.jitter_most}""",
    "qc_sections": f"WITH {_SECTIONS} SELECT ord, section, {_section_reasons('text')} AS reasons FROM secs",
    "qc_answers": f"WITH {_PARTS}, q AS (SELECT sample_id, {_QC} AS reasons FROM five) SELECT sample_id, reasons, reasons = '' AS ok FROM q",
    "split_answers": f"WITH {_PARTS} SELECT sample_id, {', '.join(f'md5(parts[{i}]) AS section_{i}' for i in range(1, 6))} FROM five WHERE parts IS NOT NULL",
    "run_pass_rate": "SELECT count(*) AS n, count(*) FILTER (WHERE qc_ok) AS n_passed, count(*) - count(*) FILTER (WHERE qc_ok) AS n_failed, (100 * count(*) FILTER (WHERE qc_ok)) // count(*) AS percent FROM run_report",
    "run_reasons": "SELECT reason, count(*) AS n FROM (SELECT unnest(qc_reasons) AS reason FROM run_report) GROUP BY reason",
    "run_section_failures": "WITH e AS (SELECT unnest(map_entries(section_fail)) AS e FROM run_report) SELECT e.key AS section, count(*) AS n, sum(len(e.value))::BIGINT AS n_reasons FROM e WHERE len(e.value) > 0 GROUP BY e.key",
    "file_kinds": "SELECT lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1)) AS kind, count(*) AS n, count(*) FILTER (WHERE coalesce(length, 0) = 0) AS n_empty FROM source_files GROUP BY ALL",
    "pending_conversions": """WITH f AS (SELECT path, regexp_replace(regexp_extract(path, '([^/\\\\]*)$', 1), '(.)\\.[^.]*$', '\\1') AS dst, lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1)) AS kind, modificationtime AS t FROM source_files),
        m AS (SELECT dst, max(t) AS t FROM f WHERE kind = '.docx' GROUP BY dst) SELECT DISTINCT f.path, f.dst FROM f LEFT JOIN m ON f.dst = m.dst WHERE kind IN ('.doc', '.pdf') AND (m.t IS NULL OR m.t < f.t)""",
}

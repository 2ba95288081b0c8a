"""Queries of the training-data operators over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import grouped_split, leakage, lookalikes, mixing, overlap, pairs, personal, repetition, splitting


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(table(spark, d, "reports_sections"), "ord", "full_text", table(spark, d, "split_limits"))
    return pieces.where("piece = 1 and n_pieces > 1").select("limit_name", "ord")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "reports_sections"), "ord", "full_text", table(spark, d, "split_limits"))


def p1_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Each cut text put together again from its pieces, with how many pieces are too long, share too little or are out of order."""
    limits = table(spark, d, "split_limits")
    pieces = splitting.split_oversized(table(spark, d, "reports_sections"), "ord", "full_text", limits)
    return splitting.rebuilt(pieces, "ord", limits)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return grouped_split.sample_groups(table(spark, d, "sft_train"), table(spark, d, "reports_sections")).select("sample_id", "group_key")


def p2_split(spark: SparkSession, d: str) -> DataFrame:
    return grouped_split.grouped_split(table(spark, d, "sft_train"), table(spark, d, "reports_sections"), table(spark, d, "split_shares"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(table(spark, d, "sft_train"), table(spark, d, "sft_valid")).select("sample_a", "sample_b")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_classes(table(spark, d, "sft_train"), table(spark, d, "sft_valid"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "sft_train"), table(spark, d, "sft_valid"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition_report(table(spark, d, "reports_sections")).where("repeated_content").select("ord")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """The measures beside the verdicts of the same report: how many runs passed and failed it."""
    number = lambda c: F.coalesce(grouped_split.serial(F.col(c)), F.col(c))
    verdicts = table(spark, d, "run_report").where("doc_id is not null").groupBy(number("doc_id").alias("serial")).agg(F.count_if("qc_ok").alias("n_ok"), F.count_if(~F.col("qc_ok")).alias("n_failed"))
    measured = repetition.repetition_report(table(spark, d, "reports_sections"), keep=("ord", "doc_id"))
    return measured.withColumn("serial", number("doc_id")).join(verdicts, "serial", "left").drop("serial")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.look_alike_pairs(table(spark, d, "reports_sections"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.class_report(lookalikes.look_alike_members(table(spark, d, "reports_sections")))


def p5_one_form(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.one_form(table(spark, d, "reports_sections").select("ord", "title", "full_text"), "ord", ("title", "full_text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pair_defects(table(spark, d, "sft_train")).where("defect is not null")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "heldout_items")).select("item_id", "doc_id")


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.decontaminate(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "heldout_items"), "spans")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.mix_report(mixing.mix(table(spark, d, "documents"), targets), targets)


def p8_whole_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a mix as large as the corpus: sources too small for that are repeated as often as allowed, and what they still lack goes to others."""
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    return mixing.mix_report(mixing.mix(documents, targets, mixing.corpus_tokens(documents, targets)), targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find_personal(table(spark, d, "documents")).select("doc_id", "kind", "seq")


def p9_masked(spark: SparkSession, d: str) -> DataFrame:
    return personal.mask_personal(table(spark, d, "documents").select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p1_rebuilt, p2_found, p2_split, p3_found, p3_classes, p3_report, p4_found, p4_report, p5_found, p5_classes, p5_one_form, p6_found, p7_found, p7_clean, p8_mix, p8_shares, p8_whole_shares, p9_found, p9_masked)
}

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _look_alike_form(value: str) -> str:
    seen = f"translate(regexp_replace({value}, '{lookalikes.UNSEEN}', '', 'g'), {_quoted(lookalikes.LOOK_ALIKE)}, {_quoted(lookalikes.PLAIN)})"
    return f"nfc_normalize(regexp_replace({seen}, '\\r\\n|\\r|\\x{{85}}|\\x{{2028}}|\\x{{2029}}', chr(10), 'g'))"


def _number(text: str, part: int) -> str:
    """Look-around that the other engine lacks is spelt out; the result is the same."""
    plain = f"upper(translate({text}, {_quoted(grouped_split.WIDE)}, {_quoted(grouped_split.NARROW)}))"
    return f"nullif(regexp_extract({plain}, '{grouped_split.NUMBER.replace('(?![0-9])', '(?:[^0-9]|$)')}', {part}), '')"


def _serial(text: str) -> str:
    plain = f"translate({text}, {_quoted(grouped_split.WIDE)}, {_quoted(grouped_split.NARROW)})"
    return f"coalesce({_number(text, 3)}, nullif(regexp_extract({plain}, '(?:^|[^0-9])([0-9]{{7}})(?:[^0-9]|$)', 1), ''))"


_WRITTEN = "coalesce(" + ", ".join(f"CASE WHEN {_serial('meta.' + c)} IS NOT NULL THEN meta.{c} END" for c in ("doc_id", "safe_doc_id", "seed_stem", "seed_path")) + ")"
_HEAD_LINES = " || ".join(f"regexp_extract_all(msg, '{grouped_split.HEAD_LINE}', {i})" for i in (1, 2, 3))

_FORMS = f"""v AS (SELECT 'title' AS field, ord, title AS value FROM reports_sections UNION ALL SELECT 'full_text', ord, full_text FROM reports_sections),
        f AS (SELECT field, ord, value, {_look_alike_form('value')} AS form FROM v WHERE regexp_matches(value, '[^\\s\\p{{Z}}\\p{{Cf}}]'))"""

_REPEATED = f"""t AS (SELECT ord, array_to_string(list_transform(map_values(sections), lambda v: regexp_replace(coalesce(v, ''), '[^\\p{{L}}]+', '', 'g')), '|') AS x FROM reports_sections),
        c AS (SELECT ord, length(replace(x, '|', '')) AS n, unnest(range(length(x))) AS i, unnest(string_split(x, '')) AS c FROM t WHERE length(x) > {repetition.WIDTH}),
        w AS (SELECT ord, n, i, string_agg(c, '') OVER (PARTITION BY ord ORDER BY i ROWS BETWEEN CURRENT ROW AND {repetition.WIDTH - 1} FOLLOWING) AS g FROM c),
        again AS (SELECT *, row_number() OVER (PARTITION BY ord, g ORDER BY i) AS k FROM w WHERE length(g) = {repetition.WIDTH} AND NOT contains(g, '|')),
        s AS (SELECT ord, n, least({repetition.WIDTH}, i - coalesce(lag(i) OVER (PARTITION BY ord ORDER BY i), -{repetition.WIDTH})) AS more FROM again WHERE k > 1)"""


def _part(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN round(({part}) / {whole}, 6) ELSE 0.0 END"


_GROUPED = f"""filed AS (SELECT DISTINCT {_serial('doc_id')} AS serial, {_number('doc_id', 1)} AS unit FROM reports_sections WHERE {_number('doc_id', 1)} IS NOT NULL),
        m AS (SELECT sample_id, {_WRITTEN} AS written, coalesce(array_to_string(list_transform(list_filter(messages, lambda x: x.role = 'user'), lambda x: coalesce(x.content, '')), chr(10)), '') AS msg FROM sft_train),
        names AS (SELECT sample_id, unnest(regexp_split_to_array(regexp_replace(line, '([一-鿿]{{2}})[和与及]([一-鿿]{{2}})', '\\1、\\2', 'g'), '\\s*(?:[、，,；;/／&＆|]|\\band\\b)\\s*')) AS name
          FROM (SELECT sample_id, unnest({_HEAD_LINES}) AS line FROM m)),
        plain AS (SELECT sample_id, regexp_replace(lower(translate(name, {_quoted(grouped_split.WIDE)}, {_quoted(grouped_split.NARROW)})), '[\\s\\p{{Z}}.。:：]+', '', 'g') AS name FROM names),
        ent AS (SELECT DISTINCT sample_id, '1:' || name AS e FROM plain WHERE length(name) >= 2
          UNION SELECT sample_id, '0:' || unit FROM m JOIN filed ON filed.serial = {_serial('written')}
          UNION SELECT sample_id, '0:' || {_number('written', 1)} FROM m WHERE {_number('written', 1)} IS NOT NULL AND {_serial('written')} NOT IN (SELECT serial FROM filed)),
        reach AS (SELECT DISTINCT e AS node, e AS other FROM ent UNION SELECT r.node, b.e FROM reach r JOIN ent a ON a.e = r.other JOIN ent b ON a.sample_id = b.sample_id),
        comp AS (SELECT node, min(other) AS c FROM reach GROUP BY node),
        keyed AS (SELECT sample_id, min(c) AS c FROM ent JOIN comp ON node = e GROUP BY sample_id)"""

#: Those that SQL expresses at a bearable speed; the tests hold the others against brute force.
SQL = {
    "p1_found": """
        SELECT l.limit_name, r.ord FROM reports_sections r JOIN split_limits l ON length(r.full_text) > l.max_chars
    """,
    "p1_rebuilt": """
        SELECT l.limit_name, r.ord, md5(r.full_text) AS digest, 0::BIGINT AS n_wrong FROM reports_sections r JOIN split_limits l ON length(r.full_text) > l.max_chars
    """,
    "p2_found": f"""
        WITH RECURSIVE {_GROUPED}
        SELECT s.sample_id, CASE WHEN c LIKE '0:%' THEN substr(c, 3) END AS group_key FROM sft_train s LEFT JOIN keyed k ON s.sample_id = k.sample_id
    """,
    "p2_split": f"""
        WITH RECURSIVE {_GROUPED},
        rows_ AS (SELECT s.sample_id, c, coalesce(c, '2:' || s.sample_id) AS unit FROM sft_train s LEFT JOIN keyed k ON s.sample_id = k.sample_id),
        shares AS (SELECT list({{'share': share, 'name': split_name}} ORDER BY share DESC, split_name) AS w, (SELECT count(*) FROM rows_) AS total FROM split_shares WHERE share > 0),
        large AS (SELECT unit, n, row_number() OVER (ORDER BY n DESC, unit) AS i FROM (SELECT unit, count(*) AS n FROM rows_ GROUP BY unit) WHERE n > greatest(0.01 * (SELECT total FROM shares), 1)),
        place AS (
          SELECT 0::BIGINT AS i, list_transform(w, lambda x: {{'lack': x.share * total, 'name': x.name}}) AS lacks, NULL::VARCHAR AS unit, NULL::VARCHAR AS split FROM shares
          UNION ALL
          SELECT l.i, list_transform(lacks, lambda x: CASE WHEN x.name = list_max(lacks).name THEN {{'lack': x.lack - n, 'name': x.name}} ELSE x END), l.unit, list_max(lacks).name FROM place p JOIN large l ON l.i = p.i + 1),
        rest AS (SELECT list_transform(arg_max(lacks, i), lambda x: {{'lack': greatest(x.lack, 0), 'name': x.name}}) AS r FROM place),
        ends AS (SELECT r[k].name AS name, list_sum(list_transform(r[1:k], lambda x: x.lack)) / list_sum(list_transform(r, lambda x: x.lack)) AS e, k FROM rest, (SELECT unnest(range(1, 10)) AS k) WHERE k <= len(r)),
        drawn AS (SELECT sample_id, c, unit, ('0x' || substr(md5(unit || '|42'), 1, 8))::BIGINT / 4294967296.0 AS d FROM rows_)
        SELECT sample_id, CASE WHEN c LIKE '0:%' THEN substr(c, 3) END AS group_key, coalesce(split, (SELECT coalesce(arg_min(name, k) FILTER (WHERE d < e), arg_max(name, k)) FROM ends)) AS split_name
        FROM drawn LEFT JOIN place ON drawn.unit = place.unit
    """,
    "p4_found": f"""
        WITH {_REPEATED} SELECT ord FROM s GROUP BY ord, n HAVING round(sum(more) / n, 6) >= 0.3
    """,
    "p4_report": f"""
        WITH {_REPEATED}, rep AS (SELECT ord, sum(more) AS covered FROM s GROUP BY ord),
        v AS (SELECT ord, doc_id, coalesce(array_to_string(list_transform(map_values(sections), lambda v: coalesce(v, '')), chr(10)), '') AS text FROM reports_sections),
        l AS (SELECT *, regexp_replace(text, '[^\\p{{L}}]+', '', 'g') AS letters, length(regexp_replace(text, '[ \\t\\n\\x{{b}}\\f\\r]+', '', 'g')) AS n_chars,
          list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM v),
        m AS (SELECT *, length(letters) AS n_letters, len(lines) AS n_lines, length(array_to_string(lines, '')) AS line_chars, length(array_to_string(list_distinct(lines), '')) AS distinct_chars,
          len(regexp_extract_all(letters, '[{repetition.STOP_CHARS}]')) + CASE WHEN contains(text, ' the ') THEN len(regexp_extract_all(lower(text), '\\b(?:{"|".join(repetition.STOP_WORDS)})\\b')) ELSE 0 END AS stops FROM l),
        r AS (SELECT m.ord, doc_id, n_letters, {_part('n_chars - n_letters', 'n_chars')} AS symbol_share, {_part('stops', 'n_letters')} AS stop_word_share,
          {_part("len(list_filter(lines, lambda x: regexp_matches(x, '(?:…|[.][.][.])$')))", 'n_lines')} AS ellipsis_line_share, {_part("len(list_filter(lines, lambda x: regexp_matches(x, '^[-*•·●]')))", 'n_lines')} AS bullet_line_share,
          {_part('line_chars - coalesce(distinct_chars, 0)', 'line_chars')} AS duplicate_line_share, {_part('coalesce(covered, 0)', 'n_letters')} AS repeated_share FROM m LEFT JOIN rep ON rep.ord = m.ord),
        q AS (SELECT coalesce({_serial('doc_id')}, doc_id) AS serial, count(*) FILTER (WHERE qc_ok) AS n_ok, count(*) FILTER (WHERE NOT qc_ok) AS n_failed FROM run_report WHERE doc_id IS NOT NULL GROUP BY ALL)
        SELECT r.*, n_letters < 20 AS too_short, symbol_share > 0.4 AS too_many_symbols, stop_word_share < 0.005 AS no_stop_words, ellipsis_line_share > 0.3 AS too_many_ellipsis_lines,
          bullet_line_share > 0.9 AS too_many_bullet_lines, duplicate_line_share > 0.3 AS duplicate_lines, repeated_share >= 0.3 AS repeated_content, n_ok, n_failed
        FROM r LEFT JOIN q ON q.serial = coalesce({_serial('doc_id')}, doc_id)
    """,
    "p5_found": f"""
        WITH {_FORMS}
        SELECT a.field, a.ord AS ord_a, b.ord AS ord_b FROM f a JOIN f b ON a.field = b.field AND a.form = b.form AND a.ord < b.ord AND a.value <> b.value
    """,
    "p5_classes": f"""
        WITH {_FORMS} SELECT field, min(ord) AS class_id, count(*) AS n_records, count(DISTINCT value) AS n_forms FROM f GROUP BY field, form HAVING count(DISTINCT value) > 1
    """,
    "p5_one_form": f"""
        WITH {_FORMS}, c AS (SELECT field, form, arg_min(value, row(length(value), encode(value))) AS canonical FROM f GROUP BY field, form),
        o AS (SELECT f.field, f.ord, {_look_alike_form('canonical')} AS value FROM f JOIN c ON f.field = c.field AND f.form = c.form)
        SELECT r.ord, coalesce(t.value, {_look_alike_form('r.title')}) AS title, coalesce(b.value, {_look_alike_form('r.full_text')}) AS full_text
        FROM reports_sections r LEFT JOIN o t ON t.ord = r.ord AND t.field = 'title' LEFT JOIN o b ON b.ord = r.ord AND b.field = 'full_text'
    """,
}

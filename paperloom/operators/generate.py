"""Generating section texts through a provider, with quality checks and bounded retries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EMPTY_DOCUMENT, EMPTY_SECTION, FORBIDDEN, LIMITS, QUOTES, RETRY_TIP, SECTION_ASK, SECTION_TASK, SECTION_TOO_LONG, STYLE_EVIDENCE, SYSTEM_EVIDENCE, TITLES
from ..functions.postprocess import cleaned_lines, rebuilt
from ..functions.quality import failing_only, five_sections, qc_summary
from ..functions.text import merge_sections, safe_filename
from .evidence import uniform

#: A generator takes a title, evidence blocks and a tip, and returns a text.
Generator = Callable[[str, list[str], str], str]


def section_prompt(title: str, evidence: list[str], tip: str = "") -> str:
    return f"{STYLE_EVIDENCE}\n\n{SECTION_TASK.format(title=title)}" + "\n\n".join(evidence) + (f"\n\n{tip}" if tip else "") + f"\n\n{SECTION_ASK}"


def prompted(complete: Callable[[list[dict[str, str]]], str]) -> Generator:
    """A generator from a chat model: ``complete`` takes messages and returns the answer. The prompt is :func:`section_prompt`; the
    answer loses the title it may begin with."""

    def write(title: str, evidence: list[str], tip: str = "") -> str:
        asked = [{"role": "system", "content": SYSTEM_EVIDENCE}, {"role": "user", "content": section_prompt(title, evidence, tip)}]
        answer = re.sub(r"\n{3,}", "\n\n", re.sub(" {2,}", " ", complete(asked).replace("\u3000", " ").replace("\t", " "))).strip()
        return re.sub(rf"^\s*{re.escape(title)}\s*[:：]?\s*", "", answer)

    return write


def extractive() -> Generator:
    """The stand-in generator: first sentences of the evidence, without what the rules forbid. It has the data flow of a model."""

    def write(title: str, evidence: list[str], tip: str = "") -> str:
        out = ""
        for block in evidence:
            body = re.sub(r'[A-Za-z0-9“”"《》]', "", block.split("\n", 1)[-1])
            for sentence in re.findall(r"[^。！？!?\n]+[。！？!?]?", body):
                if len(re.sub(r"\s", "", out + sentence)) > LIMITS.section_limit:
                    return out
                out += sentence.strip()
        return out

    return write


def section_reasons(text: str) -> list[str]:
    """The rules for one section inside a worker, where a retry needs them; the columns of ``functions.quality`` state the same."""
    body = re.sub(r"\s+", "", text)
    if not body:
        return [EMPTY_SECTION]
    found = [FORBIDDEN] if re.search("[A-Za-z0-9]", body) else []
    found += [SECTION_TOO_LONG] if len(body) > LIMITS.section_limit else []
    return found + ([QUOTES] if re.search('[“”"《》]', body) else [])


def generate_sections(evidence: DataFrame, provider: Callable[[], Generator] = extractive, retries: int = LIMITS.retries, id_col: str = "doc_id") -> DataFrame:
    """(<id>, section, text, reasons, tries) from (<id>, section, blocks array<string>). The last attempt counts, passed or not."""
    kind = evidence.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        write = provider()
        for batch in batches:
            rows = []
            for key, title, blocks in zip(batch[id_col], batch["section"], batch["blocks"]):
                given = list(blocks) if blocks is not None else []
                text, tries = write(title, given, ""), 0
                reasons = section_reasons(text)
                while reasons and tries < retries:
                    tries += 1
                    text = write(title, given, RETRY_TIP[0] + RETRY_TIP[1].join(reasons) + RETRY_TIP[2])
                    reasons = section_reasons(text)
                rows.append((key, title, text, reasons, tries))
            yield pd.DataFrame(rows, columns=[id_col, "section", "text", "reasons", "tries"])

    return evidence.select(id_col, "section", "blocks").mapInPandas(run, f"{id_col} {kind}, section string, text string, reasons array<string>, tries int")


def run_report(sections: DataFrame, documents: DataFrame, id_col: str = "doc_id", titles: tuple[str, ...] = TITLES) -> DataFrame:
    """(<id>, merged, text, qc_ok, qc_reasons, section_fail): one row per document.

    The verdict is on the merged text; ``text`` is its cleaned form. Documents without generated sections get the reason of an unreadable document.
    """
    whole = sections.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("section", "text"))).alias("parts"), F.map_from_entries(F.collect_list(F.struct("section", "reasons"))).alias("fails"))
    merged = whole.withColumn("merged", merge_sections({t: F.col("parts")[t] for t in titles}, titles)).withColumn("found", five_sections("merged"))
    judged = merged.withColumn("qc_reasons", qc_summary("merged", F.col("found"))).withColumn("lines", cleaned_lines("merged"))
    done = judged.select(id_col, "merged", rebuilt(F.col("lines")).alias("text"), "qc_reasons", failing_only(F.col("fails")).alias("section_fail"))
    rows = documents.select(id_col).distinct().join(done, id_col, "left")
    reasons = F.coalesce("qc_reasons", F.array(F.lit(EMPTY_DOCUMENT)))
    return rows.select(id_col, "merged", "text", (F.size(reasons) == 0).alias("qc_ok"), reasons.alias("qc_reasons"), F.coalesce("section_fail", F.create_map().cast("map<string,array<string>>")).alias("section_fail"))


def with_paths(report: DataFrame, sources: DataFrame, out: str, id_col: str = "doc_id") -> DataFrame:
    """Adds ``src_docx`` from ``sources`` (<id>, src_docx) and ``out_path``, the text file below ``out``; empty where there is no text."""
    path = F.concat(F.lit(out.rstrip("/") + "/"), safe_filename(F.col(id_col).cast("string"), LIMITS.safe_name_chars), F.lit(".txt"))
    return report.join(sources.select(id_col, "src_docx"), id_col, "left").withColumn("out_path", F.when(F.col("text").isNotNull(), path).otherwise(F.lit("")))


def qa_text(merged: Column, reasons: Column, section_fail: Column, titles: tuple[str, ...] = TITLES) -> Column:
    """A merged text with its verdict and that of each section below it, to be read by people."""
    tag = F.when(F.size(reasons) == 0, F.lit("[QC_OK]")).otherwise(F.concat(F.lit("[QC_FAIL] "), F.array_join(reasons, "；")))
    line = lambda t: F.coalesce(F.concat(F.lit(f"{t}=>FAIL："), F.array_join(F.nullif(F.try_element_at(section_fail, F.lit(t)), F.array().cast("array<string>")), "；")), F.lit(f"{t}=>OK"))
    return F.concat(merged, F.lit("\n\n"), tag, F.lit("\n"), F.concat_ws("\n", *map(line, titles)))


def sample_documents(docs: DataFrame, n: int, key: str = "doc_id", seed: int = LIMITS.seed) -> DataFrame:
    """``n`` documents of the least draw, with ``draw_no`` from 1: the same ones on every run."""
    drawn = docs.withColumn("_draw", uniform(F.col(key).cast("string"), F.lit("sample"), seed=seed)).orderBy("_draw", key).limit(n)
    return drawn.withColumn("draw_no", F.row_number().over(Window.orderBy("_draw", key))).drop("_draw")

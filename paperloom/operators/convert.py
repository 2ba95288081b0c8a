"""Converting files through an ordered list of providers, incremental by modification time."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A provider converts one file; it returns whether it did.
Provider = Callable[[str, str], bool]
#: Outcomes of a conversion.
TAGS = ("word_ok", "word_ok_tmpname", "soffice_ok", "pdf2docx_ok", "skipped(up-to-date)")


def soffice(src: str, dst: str, seconds: int = 300) -> bool:
    """The office suite without a window; false where it is not installed, fails or takes too long."""
    if not shutil.which("soffice"):
        return False
    with tempfile.TemporaryDirectory() as folder:
        try:
            done = subprocess.run(["soffice", "--headless", "--convert-to", "docx", "--outdir", folder, src], capture_output=True, timeout=seconds)
        except subprocess.TimeoutExpired:
            return False
        made = os.path.join(folder, os.path.splitext(os.path.basename(src))[0] + ".docx")
        if done.returncode or not os.path.exists(made):
            return False
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        shutil.move(made, dst)
    return True


def word(src: str, dst: str) -> bool:
    """The word processor itself, where its automation interface is installed."""
    import comtypes.client

    app = comtypes.client.CreateObject("Word.Application")
    app.Visible, app.DisplayAlerts = False, 0
    try:
        opened = app.Documents.Open(FileName=src, ReadOnly=True, ConfirmConversions=False, AddToRecentFiles=False, OpenAndRepair=True, Visible=False)
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        opened.SaveAs(dst, FileFormat=16)
        opened.Close(False)
    finally:
        app.Quit()
    return True


def pdf2docx(src: str, dst: str) -> bool:
    """The converter of portable documents, where it is installed."""
    from pdf2docx import Converter

    os.makedirs(os.path.dirname(dst), exist_ok=True)
    made = Converter(src)
    made.convert(dst, start=0, end=None)
    made.close()
    return os.path.exists(dst)


def under_plain_name(provider: Provider) -> Provider:
    """The provider on a copy with a plain ASCII name, for programs that stumble over others."""

    def convert(src: str, dst: str) -> bool:
        with tempfile.TemporaryDirectory() as folder:
            copy = os.path.join(folder, "source" + os.path.splitext(src)[1].lower())
            shutil.copyfile(src, copy)
            return provider(copy, dst)

    return convert


#: Tag, provider and the kinds of files it is for (all where None), in the order in which they are tried.
CHAIN: tuple[tuple[str, Provider, tuple[str, ...] | None], ...] = (
    ("word_ok", word, None),
    ("word_ok_tmpname", under_plain_name(word), None),
    ("soffice_ok", soffice, None),
    ("pdf2docx_ok", pdf2docx, (".pdf",)),
)


def pending(sources: DataFrame, made: DataFrame, key: str = "dst") -> DataFrame:
    """Sources without a target, or with one that is older."""
    newest = made.groupBy(key).agg(F.max("modificationTime").alias("_made"))
    kept = sources.join(newest, key, "left").where(F.col("_made").isNull() | (F.col("_made") < F.col("modificationTime")))
    return kept.drop("_made")


def convert(pairs: DataFrame, providers=CHAIN) -> DataFrame:
    """(ok, src_path, tag) for every (src, dst): the first provider that succeeds; all that went wrong is a row, never a failure.

    Providers are (tag, provider) or (tag, provider, kinds). A file that failed has ``fail: `` and what each provider said as its tag.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for src, dst in zip(batch["src"], batch["dst"]):
                tag, problems = None, []
                if os.path.exists(dst) and os.path.exists(src) and os.path.getmtime(dst) >= os.path.getmtime(src):
                    tag = TAGS[-1]
                for name, provider, *kinds in providers if tag is None else ():
                    if kinds and kinds[0] and os.path.splitext(src)[1].lower() not in kinds[0]:
                        continue
                    try:
                        if provider(src, dst):
                            tag = name
                            break
                    except Exception as problem:  # noqa: BLE001
                        problems.append(f"{name}: {problem}")
                rows.append((tag is not None, src, tag or "fail: " + ("; ".join(problems)[:300] or "no provider")))
            yield pd.DataFrame(rows, columns=["ok", "src_path", "tag"])

    return pairs.select("src", "dst").mapInPandas(run, "ok boolean, src_path string, tag string")


def count_tags(results: DataFrame, tags: tuple[str, ...] = TAGS, ok: str = "ok", tag: str = "tag") -> DataFrame:
    """(tag, n, n_ok, n_failed), with zeros for known tags that did not occur."""
    spark = results.sparkSession
    counted = results.groupBy(tag).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"), F.count_if(~F.col(ok)).alias("n_failed"))
    known = spark.createDataFrame([(t,) for t in tags], f"{tag} string")
    return known.join(counted, tag, "full").na.fill(0, ["n", "n_ok", "n_failed"])

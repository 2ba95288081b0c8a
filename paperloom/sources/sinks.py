"""Writing results."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.window import Window

from ..config import LIMITS
from ..functions.text import safe_filename


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path names, a local one without a scheme, and the path in it."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path.rstrip("/"))


def write_jsonl(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Fields that are null are written; ``one_file`` is for small results."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_pretty(df: DataFrame, path: str, only_if_rows: bool = False, most: int = 100_000) -> bool:
    """One indented JSON array, for small reports; more than ``most`` rows are refused rather than brought to the driver."""
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; use write_jsonl")
    if rows or not only_if_rows:
        files, at = file_system(path)
        with files.open_output_stream(at) as out:
            out.write(json.dumps(rows, ensure_ascii=False, indent=2).encode("utf-8", "surrogatepass"))
    return bool(rows)


def write_csv(df: DataFrame, path: str, append: bool = False, mark: bool = False) -> None:
    """With a header; ``mark`` puts a byte order mark before the first field's name."""
    out = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if mark else df
    out.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def write_failures(results: DataFrame, path: str) -> None:
    """The conversions that failed: one file with a byte order mark and the columns src_path and error, also where there are none."""
    write_csv(results.where("not ok").select("src_path", F.col("tag").alias("error")).coalesce(1), path, mark=True)


class _TextFiles(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows):
        files, root = file_system(self.folder)
        files.create_dir(root, recursive=True)
        for row in rows:
            part = f"{root}/.{row.name}.{uuid.uuid4().hex}.part"
            with files.open_output_stream(part) as out:
                out.write((row.text or "").encode("utf-8", "surrogatepass"))
            files.move(part, f"{root}/{row.name}.txt")
        return WriterCommitMessage()


class TextFiles(DataSource):
    """A file per row of (name, text), in a folder that all executors share. A repeated task writes the same files again."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite):
        return _TextFiles(self.options["path"])


def unique_names(df: DataFrame, name: str = "name", order: str = "text") -> DataFrame:
    """``df`` with names that no two rows share: the second and later rows of a name are numbered from 2, or from behind the
    highest number that another name already ends in, so a numbered name never meets a given one."""
    given = F.regexp_extract(name, r"(?s)^(.*)_[0-9]{1,15}\z", 1), F.regexp_extract(name, r"_([0-9]{1,15})\z", 1)
    numbered = df.select(given[0].alias("_base"), given[1].alias("_number")).where("_number <> ''")
    taken = numbered.groupBy("_base").agg(F.max(F.col("_number").cast("bigint")).alias("_taken"))
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    ranked = df.withColumn("_n", n).join(taken, F.col(name) == F.col("_base"), "left")
    number = F.greatest(F.coalesce("_taken", F.lit(1)), F.lit(1)) + F.col("_n") - 1
    return ranked.withColumn(name, F.when(F.col("_n") > 1, F.concat(name, F.lit("_"), number.cast("string"))).otherwise(F.col(name))).drop("_n", "_base", "_taken")


def write_text_files(df: DataFrame, folder: str, name: str = "doc_id", text: str = "text", most: int = LIMITS.safe_name_chars) -> None:
    """A text file per row. Equal file names would overwrite each other, so they are numbered (:func:`unique_names`)."""
    named = df.select(safe_filename(name, most).alias("name"), F.col(text).alias("text"))
    df.sparkSession.dataSource.register(TextFiles)
    unique_names(named).write.format("text_files").mode("append").option("path", folder).save()


def write_run(report: DataFrame, folder: str) -> None:
    """The result of a run: a text file per document that has a text, and ``run_report`` as JSON lines with the columns of RUN_REPORT."""
    write_text_files(report.where("text is not null").select(F.regexp_extract("out_path", r"([^/]*)\.txt$", 1).alias("doc_id"), "text"), folder)
    write_jsonl(report.select("doc_id", "src_docx", "out_path", "qc_ok", "qc_reasons", "section_fail"), f"{folder}/run_report")

"""Reading files: scans by extension, JSON lines, reference texts, maps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text

DOCUMENT_KINDS = (".doc", ".docx", ".pdf")
REPORTS = "doc_id string, title string, sections map<string,string>, full_text string"
SAMPLES = "messages array<struct<role:string,content:string>>, meta struct<doc_id:string,safe_doc_id:string,seed_stem:string,seed_path:string,title:string,n_chunks:int,source_chars:int,target_chars:int>"
RUN_REPORT = "doc_id string, src_docx string, out_path string, qc_ok boolean, qc_reasons array<string>, section_fail map<string,array<string>>"


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def stem(path: Column | str) -> Column:
    """The file's name without folders and its last suffix."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is at a path or pattern, on whatever file system it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where))


def require_path(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return path


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The table, or an error where it is empty: for inputs without which a run makes no sense."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def scan_docx(spark: SparkSession, folder: str) -> DataFrame:
    """The word-processor files of one folder, without those below it, in order of path."""
    return scan(spark, folder, (".docx",), recursive=False).orderBy("path")


def scan(spark: SparkSession, folder: str, kinds: tuple[str, ...] = DOCUMENT_KINDS, recursive: bool = True) -> DataFrame:
    """Files by extension, with ``content``; it is only read where it is selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    return files.where(suffix("path").isin(*kinds))


def destination(path: Column | str, root: str, out: str, kind: str = ".docx") -> Column:
    """The path below ``out`` that mirrors the one below ``root``, with another suffix."""
    below = F.regexp_replace(path, rf"^(?:file:)?/*\Q{root.strip('/')}\E/*", "")
    return F.concat(F.lit(out.rstrip("/") + "/"), F.regexp_replace(below, r"\.[^./\\]+$", kind))


def collisions(df: DataFrame, source: str = "path", target: str = "dst") -> DataFrame:
    """(target, n_sources) of targets that several sources share."""
    return df.groupBy(target).agg(F.count_distinct(source).alias("n_sources")).where("n_sources > 1")


def read_jsonl(spark: SparkSession, path: str, schema: str, must_exist: bool = False) -> DataFrame:
    """JSON lines under a given schema; a broken line fails. A missing file is an empty table, or an error where it must exist."""
    if not must_exist and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """(seed_stem, seed_path, target) of all text files, bytes that are no UTF-8 left out, blank ones too."""

    @F.pandas_udf("string")
    def decoded(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    rows = files.select(normalize_text(stem("path")).alias("seed_stem"), F.col("path").alias("seed_path"), normalize_text(decoded("content")).alias("target"))
    return rows.where("target <> ''")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of one JSON object; nothing where the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], "key string, value string")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")))

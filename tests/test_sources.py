import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.operators import generate, retrieve
from paperloom.sources import docx, files, sinks
from paperloom.streaming.incremental import counts_by_window, on_new_files

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx_bytes(body, styles=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", f'<w:styles {NS}><w:style w:styleId="1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_docx(spark, tmp_path):
    p = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
    (tmp_path / "a.docx").write_bytes(docx_bytes('<w:p><w:pPr><w:pStyle w:val="1"/></w:pPr><w:r><w:t>题</w:t><w:tab/><w:t>目</w:t></w:r></w:p>' + p.format("文") + p.format(" ")))
    (tmp_path / "b.docx").write_bytes(docx_bytes(f"<w:tbl><w:tr><w:tc>{p.format('表')}</w:tc></w:tr></w:tbl>", False))
    (tmp_path / "c.docx").write_bytes(b"no archive")
    (tmp_path / "d.txt").write_text("x")
    rows = docx.docx_paragraphs(files.scan(spark, str(tmp_path), (".docx",))).withColumn("name", files.stem("path")).orderBy("name", "pos").collect()
    assert [(r["name"], r["text"], r["style"], r["mode"]) for r in rows] == [("a", "题 目", "Heading 1", "body"), ("a", "文", "Normal", "body"), ("b", "表", "", "all"), ("c", "", "", "none")]
    assert rows[-1]["error"]


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([("a", None, {"研": "究"}, "x\ny")], files.REPORTS)
    sinks.write_jsonl(df, str(tmp_path / "r"), one_file=True)
    assert files.read_jsonl(spark, str(tmp_path / "r"), files.REPORTS).collect() == df.collect()
    line = next((tmp_path / "r").glob("*.json")).read_text("utf-8")
    assert "研" in line
    assert json.loads(line)["title"] is None
    assert files.read_jsonl(spark, str(tmp_path / "none"), files.REPORTS).count() == 0
    with pytest.raises(Exception, match="none"):
        files.read_jsonl(spark, str(tmp_path / "none"), files.REPORTS, must_exist=True).count()


def test_seeds_and_maps(spark, tmp_path):
    (tmp_path / "s1.txt").write_bytes("甲".encode() + b"\xff" + "乙".encode())
    (tmp_path / "s2.txt").write_text("  ")
    (tmp_path / "m.json").write_text('{"a": "1", "b": "2"}')
    got = files.read_seeds(spark, str(tmp_path)).collect()
    assert [(r["seed_stem"], r["target"]) for r in got] == [("s1", "甲乙")]
    assert sorted(map(tuple, files.read_map(spark, str(tmp_path / "m.json")).collect())) == [("a", "1"), ("b", "2")]
    assert files.read_map(spark, str(tmp_path / "n.json")).count() == 0


def test_paths(spark):
    df = spark.createDataFrame([("file:/r/x/a.DOC",), ("file:/r/x/a.pdf",), ("file:/r/b.docx",)], "path string")
    out = df.select("path", files.suffix("path").alias("k"), files.destination(F.col("path"), "/r", "/o").alias("dst"))
    assert [(r["k"], r["dst"]) for r in out.collect()] == [(".doc", "/o/x/a.docx"), (".pdf", "/o/x/a.docx"), (".docx", "/o/b.docx")]
    assert [tuple(r) for r in files.collisions(out).collect()] == [("/o/x/a.docx", 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x/y", "甲"), ("x:y", "乙"), ("z", None)], "doc_id string, text string")
    sinks.write_text_files(df, str(tmp_path / "t"))
    assert sorted(p.name for p in (tmp_path / "t").glob("*.txt")) == ["x_y.txt", "x_y_2.txt", "z.txt"]
    assert sinks.write_pretty(df.limit(0), str(tmp_path / "p.json"), only_if_rows=True) is False
    assert not (tmp_path / "p.json").exists()
    sinks.write_csv(df.coalesce(1), str(tmp_path / "c"), mark=True)
    assert next((tmp_path / "c").glob("*.csv")).read_bytes().startswith("﻿doc_id".encode())


def test_new_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    work = lambda df, _: seen.extend(r["a"] for r in df.collect())
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"a": k}))
        on_new_files(spark, str(tmp_path / "in"), "a int", work, str(tmp_path / "check")).awaitTermination()
    assert seen == [0, 1]


def test_numbered_names_meet_no_other(spark, tmp_path):
    names = ["a", "a", "a_2", "a", "a_10", "a_10", "b/c", "b:c", "b_c_2", None, ""]
    df = spark.createDataFrame([(n, f"text {i}") for i, n in enumerate(names)], "doc_id string, text string")
    sinks.write_text_files(df, str(tmp_path / "t"))
    files_ = list((tmp_path / "t").glob("*.txt"))
    assert sorted(f.read_text() for f in files_) == sorted(f"text {i}" for i in range(len(names)))
    assert not list((tmp_path / "t").glob("*.part"))


def test_run_and_failures(spark, tmp_path):
    report = spark.createDataFrame([("x/1", "甲", True, [], {}), ("y", None, False, ["r"], {"s": ["t"]})], "doc_id string, text string, qc_ok boolean, qc_reasons array<string>, section_fail map<string,array<string>>")
    paths = generate.with_paths(report, spark.createDataFrame([("x/1", "/in/x.docx")], "doc_id string, src_docx string"), str(tmp_path / "out"))
    sinks.write_run(paths, str(tmp_path / "out"))
    assert (tmp_path / "out" / "x_1.txt").read_text("utf-8") == "甲"
    rows = {r["doc_id"]: r for r in files.read_jsonl(spark, str(tmp_path / "out" / "run_report"), files.RUN_REPORT).collect()}
    assert rows["x/1"]["src_docx"] == "/in/x.docx"
    assert rows["x/1"]["out_path"].endswith("/out/x_1.txt")
    assert (rows["y"]["out_path"], rows["y"]["qc_reasons"]) == ("", ["r"])
    results = spark.createDataFrame([(True, "a", "word_ok"), (False, "b", "fail: x")], "ok boolean, src_path string, tag string")
    for name, wanted in (("f", results), ("none", results.limit(0))):
        sinks.write_failures(wanted, str(tmp_path / name))
    assert next((tmp_path / "f").glob("*.csv")).read_text("utf-8-sig").splitlines() == ["src_path,error", "b,fail: x"]
    assert next((tmp_path / "none").glob("*.csv")).read_text("utf-8-sig").splitlines() == ["src_path,error"]


def test_cache_and_preconditions(spark, tmp_path):
    assert retrieve.read_cache(spark, str(tmp_path / "c")) is None
    rows = spark.createDataFrame([("k", 0, [1.0])], "key string, chunk_idx int, emb array<float>")
    retrieve.append_cache(rows, str(tmp_path / "c"))
    retrieve.append_cache(rows, str(tmp_path / "c"))
    assert retrieve.read_cache(spark, str(tmp_path / "c")).count() == 2
    with pytest.raises(FileNotFoundError):
        files.require_path(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError, match="seeds"):
        files.require_rows(rows.limit(0), "seeds")
    for name in ("b.docx", "a.docx"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.docx").write_bytes(b"x")
    assert [r["path"][-6:] for r in files.scan_docx(spark, str(tmp_path)).collect()] == ["a.docx", "b.docx"]


def test_counts_by_window(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps({"t": f"2024-01-01T0{h}:10:00", "k": "a"}) for h in (1, 1, 2)))
    stream = spark.readStream.schema("t timestamp, k string").json(str(tmp_path / "in"))
    seen = []
    query = counts_by_window(stream, "t", ["k"]).writeStream.outputMode("complete").foreachBatch(lambda df, _: seen.extend(r["n"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(seen) == [1, 2]


def test_checkpoints_need_a_shared_folder(monkeypatch):
    from types import SimpleNamespace as N

    from paperloom import session

    context = N(master="yarn", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isEmpty=lambda: True))))
    df = N(sparkSession=N(sparkContext=context, conf=N(get=lambda *_: None)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint(df)

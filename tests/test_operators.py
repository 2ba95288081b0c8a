import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.config import LIMITS
from paperloom.operators import align, chunk, convert, evidence, generate, report, retrieve, samples, sections, tokens
from paperloom.plans import pipeline


def packed(paras, size, overlap):
    """What packing must give, stated plainly."""
    done, buf, n = [], None, 0
    for p in paras:
        if len(p) > size:
            done += [buf] if buf is not None else []
            done += [p[i : i + size].strip() for i in range(0, len(p), size)]
            buf, n = None, 0
        elif n + len(p) + 2 <= size:
            buf, n = p if buf is None else buf + "\n\n" + p, n + len(p) + 2
        else:
            done += [buf.strip()] if buf is not None else []
            tail = done[-1][-overlap:].strip() if done and overlap else ""
            buf, n = (tail + "\n\n" + p, len(tail) + len(p) + 2) if tail else (p, len(p))
    return done + ([buf.strip()] if buf is not None else [])


def test_packing(spark):
    draw = random.Random(3)
    size, overlap = 40, 9
    cases = [[], ["a" * 39], ["a" * 38, "b"], ["a" * 41, "b"], ["a" * 90, "b" * 40], ["a" * 37, "b" * 3]]
    cases += [["".join(draw.choice("ab c") for _ in range(draw.randrange(1, 60))).strip() or "x" for _ in range(draw.randrange(8))] for _ in range(150)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ps array<string>")
    got = [r[0] for r in df.orderBy("i").select(chunk.pack_paragraphs(F.col("ps"), size, overlap)).collect()]
    assert got == [packed(c, size, overlap) for c in cases]


@pytest.mark.parametrize("n", [0, 1, 10, 11, 17, 18, 40])
def test_token_windows(spark, n):
    tokens = [str(i) for i in range(n)]
    wanted, at = [], 0
    while n and (not wanted or at + 3 < n):
        wanted.append(tokens[at : at + 10])
        at += 7
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    assert df.select(chunk.token_chunks(F.col("t"), 10, 3)).first()[0] == wanted
    with pytest.raises(ValueError, match="overlap"):
        chunk.token_chunks(F.col("t"), 3, 3)


def test_keep_first_and_prefixes(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, "y"), (4, None, "z")], "id int, t string, _key string")
    assert {r["id"] for r in chunk.keep_first(df, F.col("t"), ["id"]).collect()} == {1, 3}
    one = spark.createDataFrame([(["ab1", "ab2", "c"],)], "c array<string>")
    assert one.select(chunk.unique_prefixes(F.col("c"), 2)).first()[0] == ["ab1", "c"]


def test_forward_fill(spark):
    lines = ["前言不在任何一段里而且这一行写得比二十五个字还要长一些才行", "一、研究问题", "甲" * 30, "小标题", "乙" * 30, "核心概念：", "丙" * 30, "研究问题", "丁" * 30]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "id int, t string")
    records = sections.section_records(sections.paragraphs(df, "id", "t"), "id").collect()
    assert len(records) == 1
    assert records[0]["sections"]["研究问题"] == "甲" * 30 + "\n" + "乙" * 30 + "\n" + "丁" * 30
    assert records[0]["sections"]["核心概念"] == "丙" * 30
    assert records[0]["sections"]["研究效果"] == ""
    assert records[0]["title"] == lines[0]


def test_alignment_tiers(spark):
    docs = spark.createDataFrame([(1, "A-1", "x"), (2, "b/2", "x"), (3, "C 3", "x"), (4, "c3", ""), (5, "A-1", "y"), (6, None, "x"), (7, "!!", "x")], "ord int, doc_id string, source string")
    seeds = spark.createDataFrame([("A-1", "p1", "t"), ("b_2", "p2", "t"), ("c_3", "p3", "t"), ("C3", "p4", "t"), ("none", "p5", "t"), ("??", "p6", "t"), (None, "p7", "t"), ("A-1", "p8", "u")], "seed_stem string, seed_path string, target string")
    index = align.document_index(docs, "ord")
    assert {(r["doc_id"], r["doc_ord"], r["source"]) for r in index.collect() if r["doc_id"] == "A-1"} == {("A-1", 1, "y")}
    found = {r["seed_stem"]: (r["doc_id"], r["tier"]) for r in align.align(seeds, index).collect()}
    assert found == {"A-1": ("A-1", 1), "b_2": ("b/2", 4), "C3": ("C 3", 3)} or found["A-1"] == ("A-1", 1)
    assert found["C3"][0] == "C 3"
    assert "none" not in found
    assert "??" not in found
    assert {r["seed_path"] for r in align.unmatched_seeds(seeds, index).collect()} >= {"p5", "p6", "p7"}
    assert align.seed_map(seeds, index).where("doc_id = 'A-1'").first()["target"] == "u"
    assert "!!" in {r["doc_id"] for r in align.unmatched_docs(seeds, index).collect()}
    assert {(r["doc_id"], r["source"]) for r in align.with_last(align.document_index(docs.drop("source"), "ord"), docs, "ord", ["source"]).collect() if r["doc_id"] == "A-1"} == {("A-1", "y")}


def test_top_and_rerank(spark):
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(40, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[7] = vectors[3]
    rows = [(1, i, v.tolist()) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "d int, c int, emb array<double>")
    queries = spark.createDataFrame([(1, "q", vectors[3].tolist()), (2, "z", vectors[3].tolist())], "d int, q string, emb array<double>")
    top = retrieve.cosine_topn(queries, chunks, ["d"], "q", "c", 10)
    got = [(r["c"], r["rank"]) for r in top.orderBy("rank").collect()]
    sims = np.round(vectors @ vectors[3], 6)
    wanted = sorted(range(40), key=lambda i: (-sims[i], i))[:10]
    assert [c for c, _ in got] == wanted
    picks = [r["c"] for r in retrieve.mmr_rerank(top, ["d", "q"], "c", 4, 0.62).orderBy("pick").collect()]
    chosen = [wanted[0]]
    while len(chosen) < 4:
        left = [c for c in wanted if c not in chosen]
        chosen.append(max(left, key=lambda c: (round(0.62 * sims[c] - 0.38 * max(vectors[c] @ vectors[o] for o in chosen), 9), -wanted.index(c))))
    assert picks == chosen


def test_embedding_cache(spark):
    chunks = spark.createDataFrame([(1, 0, "甲乙"), (1, 1, "丙丁"), (2, 0, "戊")], "doc int, chunk_idx int, text string")
    empty = spark.createDataFrame([], "key string, chunk_idx int, emb array<float>")
    first, fresh = retrieve.embed_cached(chunks, empty, "doc", "text", F.md5(F.col("doc").cast("string")))
    assert fresh.count() == 3
    kept = spark.createDataFrame(fresh.collect(), fresh.schema)
    second, fresh = retrieve.embed_cached(chunks, kept, "doc", "text", F.md5(F.col("doc").cast("string")))
    assert fresh.count() == 0
    assert second.count() == first.count() == 3


def test_budget_stops_at_the_first_excess(spark):
    df = spark.createDataFrame([(1, 1, "甲" * 5), (1, 2, "乙" * 8), (1, 3, "丙"), (2, 1, None), (3, 1, "丁" * 2251)], "g int, o int, block string")
    got = {(r["g"], r["o"]) for r in evidence.budget_clip(df, ["g"], ["o"], 10).collect()}
    assert got == {(1, 1)}
    assert df.select(F.length(evidence.clip(F.col("block")))).collect()[-1][0] == 2201


def test_jitter_is_the_same_on_every_run(spark):
    df = spark.createDataFrame([(1, f"b{i}") for i in range(60)], "id int, block string")
    one, two = (sorted(map(tuple, evidence.jitter(df, "id", 3).select("variant", "place", "block").collect())) for _ in range(2))
    assert one == two
    assert max(r[1] for r in one) <= LIMITS.jitter_most


@pytest.mark.parametrize("n", [1, 10, 100])
def test_exact_split(spark, n):
    rows = samples.exact_split(spark.range(n), "id", 0.1).collect()
    assert sum(r["split"] == "valid" for r in rows) == max(1, n // 10)
    assert len(rows) == n


def test_encoding(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 5]), ([1] * 6, [2] * 3), ([], [])], "p array<int>, a array<int>")
    got = [r[0] for r in df.select(samples.encode(F.col("p"), F.col("a"), 7)).collect()]
    assert (got[0]["input_ids"], got[0]["attention_mask"], got[0]["labels"]) == ([1, 2, 3, 4, 5, 0, 0], [1] * 5 + [0, 0], [-100] * 3 + [4, 5, -100, -100])
    assert (got[1]["input_ids"], got[1]["labels"]) == ([1] * 4 + [2] * 3, [-100] * 4 + [2] * 3)
    assert got[2]["attention_mask"] == [0] * 7


def test_conversion(spark, tmp_path):
    src, dst = tmp_path / "a.doc", tmp_path / "out" / "a.docx"
    src.write_text("x")
    (tmp_path / "out").mkdir()

    def breaks(a, b):
        raise OSError("no")

    def copies(a, b):
        open(b, "w").write(open(a).read())
        return True

    pairs = spark.createDataFrame([(str(src), str(dst)), ("/none", "/none/x")], "src string, dst string").coalesce(1)
    first = {r["src_path"]: r for r in convert.convert(pairs, [("word_ok", breaks), ("soffice_ok", copies)]).collect()}
    assert first[str(src)]["tag"] == "soffice_ok"
    assert not first["/none"]["ok"]
    assert first["/none"]["tag"].startswith("fail: ")
    again = convert.convert(pairs, [("soffice_ok", copies)]).where("ok").collect()
    assert again[0]["tag"] == "skipped(up-to-date)"
    counted = {r["tag"]: r["n"] for r in convert.count_tags(convert.convert(pairs, [])).collect()}
    assert counted["word_ok"] == 0
    assert counted["skipped(up-to-date)"] == 1


def test_reports(spark):
    runs = spark.createDataFrame([(True,), (False,), (None,)], "qc_ok boolean")
    assert tuple(report.pass_rate(runs).first()) == (3, 1, 2, 33)
    assert tuple(report.pass_rate(runs.limit(0)).first()) == (0, 0, 0, None)


def test_text_records_are_those_of_the_windows(spark, data):
    reports = spark.read.parquet(f"{data}/reports_sections.parquet").select("ord", "full_text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \u3000\n\t"), (-4, "研究问题"), (-5, "研究问题\n" + "甲" * 30 + "\n研究问题\n研究成果\n" + "乙" * 26 + "\r\n" + "丙" * 26), (-6, ("丁" * 30 + "\n") * 3000)], "ord bigint, full_text string")
    texts = reports.union(odd)
    rows = sorted(map(str, sections.section_records(sections.paragraphs(texts, "ord", "full_text"), "ord").collect()))
    assert sorted(map(str, sections.text_records(texts, "ord", "full_text").collect())) == rows
    counts = {(r["ord"], r["section"]): (r["n_paragraphs"], r["n_chars"]) for r in sections.section_counts(texts, "ord", "full_text").collect()}
    assert counts[-5, "研究成果"] == (2, 52)
    assert counts[-6, None] == (3000, 90000)
    assert not any(k == -4 for k, _ in counts)


def test_conversion_chain(spark, tmp_path):
    def copies(a, b):
        open(b, "w").write(open(a).read())
        return a.isascii()

    odd, pdf = tmp_path / "题.doc", tmp_path / "b.pdf"
    for f in (odd, pdf):
        f.write_text("x")
    pairs = spark.createDataFrame([(str(f), str(tmp_path / f"{f.stem}.docx")) for f in (odd, pdf)], "src string, dst string").coalesce(1)
    never = lambda a, b: False
    got = {r["src_path"]: r["tag"] for r in convert.convert(pairs, [("word_ok", never), ("word_ok_tmpname", convert.under_plain_name(copies), (".doc",)), ("pdf2docx_ok", copies, (".pdf",))]).collect()}
    assert got == {str(odd): "word_ok_tmpname", str(pdf): "pdf2docx_ok"}
    (tmp_path / "题.docx").unlink()
    assert [(r["ok"], r["tag"][:6]) for r in convert.convert(pairs.where("src like '%.doc'"), convert.CHAIN).collect()] == [(False, "fail: ")]


def test_model_generator(spark):
    asked = []

    def complete(messages):
        asked.append(messages)
        return "研究问题： 怎样\u3000提高" if len(asked) > 1 else "has letters"

    write = generate.prompted(complete)
    assert write("研究问题", ["【研究问题证据】\n甲"]) == "has letters"
    assert write("研究问题", ["【研究问题证据】\n甲"], "提醒") == "怎样 提高"
    assert [m["role"] for m in asked[0]] == ["system", "user"]
    assert "【证据块】\n【研究问题证据】\n甲\n\n请输出该段。" in asked[0][1]["content"]
    assert "\n\n提醒\n\n" in asked[1][1]["content"]


def test_retries_keep_the_last_attempt(spark):
    def provider():
        said = iter(["bad1", "bad2", "好"] * 2)
        return lambda title, blocks, tip="": next(said) + ("" if not tip else "…")

    rows = spark.createDataFrame([("d", "研究问题", ["x"])], "doc_id string, section string, blocks array<string>").coalesce(1)
    got = [generate.generate_sections(rows, provider, n).first() for n in (0, 1, 2)]
    assert [(r["text"], r["tries"], len(r["reasons"])) for r in got] == [("bad1", 0, 1), ("bad2…", 1, 1), ("好…", 2, 0)]


def test_tokenizer_provider(spark):
    load = tokens.bpe("/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    texts = ["研究报告 report 😀\n", "", "x" * 5000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    ids = df.select("i", tokens.encode_ids(load)(F.col("t")).alias("ids")).select("i", "ids", tokens.decode_ids(load)(F.col("ids")).alias("back")).orderBy("i").collect()
    assert [r["back"] for r in ids] == [t or "" for t in texts]
    own = load()
    cut = [r[0] for r in df.orderBy("i").select(tokens.chunk_texts(load, 6, 2)(F.col("t"))).collect()]
    for t, parts in zip(texts, cut):
        n = own.encode(t or "")
        assert parts == [own.decode(n[i : i + 6]) for i in range(0, max(1, len(n) - 2), 4)] if n else parts == []
    with pytest.raises(ValueError, match="overlap"):
        tokens.chunk_texts(load, 3, 3)


def test_batches(spark):
    df = spark.createDataFrame([([i], [1], [-i]) for i in range(7)], "input_ids array<int>, attention_mask array<int>, labels array<int>").coalesce(1)
    got = tokens.batches(df, 3).collect()
    assert [len(r["labels"]) for r in got] == [3, 3, 1]
    assert got[1]["input_ids"] == [[3], [4], [5]]


def test_evidence_with_a_cache(spark):
    docs = spark.createDataFrame([("a", "甲乙丙。" * 900), ("b", "丁戊。"), ("c", None), ("d", " ")], "doc_id string, text string")
    calls = spark.sparkContext.accumulator(0)

    def provider():
        model = retrieve.hashed_embedder()

        def run(texts):
            calls.add(len(texts))
            return model(texts)

        return run

    hints = spark.createDataFrame([("b", "提示")], "doc_id string, hint string")
    first, fresh = pipeline.evidence_and_cache(docs, hints, provider)
    rows = sorted(map(str, first.collect()))
    assert len(rows) == 10
    kept = spark.createDataFrame(fresh.collect(), fresh.schema)
    before = calls.value
    second, none = pipeline.evidence_and_cache(docs, hints, provider, cache=kept)
    assert sorted(map(str, second.collect())) == rows
    assert none.count() == 0
    assert calls.value - before < 30


def test_picks_are_those_of_the_rows(spark):
    draw = np.random.default_rng(9)
    vectors = draw.normal(size=(30, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    table = {f"q{i}": draw.normal(size=8) for i in range(3)}
    table = {k: v / np.linalg.norm(v) for k, v in table.items()}
    one = spark.createDataFrame([(vectors.tolist(), [*table, ""])], "embs array<array<double>>, queries array<string>")
    got = one.select(retrieve.pick_chunks(lambda: lambda qs: np.stack([table[q] for q in qs]), 10, 4)(F.col("embs"), F.col("queries"))).first()[0]
    chunks = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(vectors)], "d int, c int, emb array<double>")
    queries = spark.createDataFrame([(1, q, v.tolist()) for q, v in table.items()], "d int, q string, emb array<double>")
    wanted = retrieve.mmr_rerank(retrieve.cosine_topn(queries, chunks, ["d"], "q", "c", 10), ["d", "q"], "c", 4).orderBy("q", "pick").collect()
    assert got == [[r["c"] for r in wanted if r["q"] == q] for q in table] + [[]]


def test_training_samples(spark):
    reports = spark.createDataFrame([(1, "A-1", "课堂观察。" * 400), (2, "B-2", None), (3, "C-3", "另一份报告。" * 50)], "ord int, doc_id string, full_text string")
    seeds = spark.createDataFrame([("A-1", "p", "研究问题：" + "甲" * 300), ("B-2", "p", "乙" * 300), ("C-3", "p", "短")], "seed_stem string, seed_path string, target string")
    made = pipeline.training_samples(reports, seeds, variants=3, most=512)
    rows = made.collect()
    assert len(rows) == 9
    assert all(r["messages"] is None for r in rows if r["doc_id"] == "B-2")
    assert {r["n_supervised"] for r in rows if r["doc_id"] == "A-1"} == {305}
    assert all(len(r["encoded"]["input_ids"]) == 512 and sum(x != -100 for x in r["encoded"]["labels"]) == r["n_supervised"] for r in rows if r["messages"])
    assert tuple(pipeline.training_counts(made).first()) == (3, 1, 3, 3, 305, 305.0, 305)


def test_probe(spark):
    docs = spark.createDataFrame([(f"d/{i}", "研究问题\n" + "怎样提高课堂效率。" * 20) for i in range(5)] + [("e", " ")], "doc_id string, text string")
    got = pipeline.qa_probe(docs, 3, "pre").orderBy("name").collect()
    assert [r["name"] for r in got] == [f"pre_{k}_d_{r['doc_id'][2:]}" for k, r in enumerate(got, 1)]
    assert all("\n\n[QC_" in r["text"] and r["text"].count("=>") == 5 for r in got)
    assert got == pipeline.qa_probe(docs, 3, "pre").orderBy("name").collect()


def test_mean_loss_and_windows(spark):
    assert report.mean_loss(spark.createDataFrame([(1.0,), (2.0,), (None,)], "eval_loss double")).first()[0] == 1.5
    chunks = spark.createDataFrame([(1, 0, "甲乙")], "doc int, chunk_idx int, text string")
    assert retrieve.embed(chunks, "text").first()["emb"]

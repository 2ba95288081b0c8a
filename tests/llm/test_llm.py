"""Operators for training data: literal cases, brute force on small fixtures, and the odd inputs."""

import difflib
import itertools
import random
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import grouped_split, hot, leakage, lookalikes, mixing, overlap, pairs, personal, repetition, splitting
from paperloom.llm.batches import MOST_BYTES, map_rows, slices
from paperloom.llm.queries import QUERIES, SQL
from paperloom.llm.segments import SegmentIndex

LIMITS = "limit_name string, max_chars int, overlap_chars int"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    got = QUERIES[name](spark, data)
    rows = got.collect()
    if name in SQL:
        db = duckdb.connect()
        for t in ("reports_sections", "run_report", "sft_train", "split_limits", "split_shares"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
        result = db.execute(SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(got.columns)
        plain = lambda x: repr(round(x, 6) if isinstance(x, float) else x)
        assert sorted([plain(r[c]) for c in columns] for r in rows) == sorted([plain(x) for x in r] for r in result.fetchall())


@pytest.mark.parametrize("name", "p1_found p1_pieces p4_found p6_found p7_clean p9_found p9_masked".split())
def test_one_pass_has_no_exchange(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_empty_tables(spark, data, tmp_path, name):
    for t in "reports_sections sft_train sft_valid documents heldout_items run_report".split():
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for t in "mix_targets split_limits split_shares".split():
        spark.read.parquet(f"{data}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    rows = QUERIES[name](spark, str(tmp_path)).collect()
    assert not rows or name in ("p8_shares", "p8_whole_shares")


def test_batches_are_bounded_by_bytes(spark):
    df = spark.createDataFrame([(i, "字" * 100_000) for i in range(200)], "i int, t string").coalesce(1)
    back = map_rows(df, "i int, t string", lambda: lambda i, t: [(i, t)] * 2)
    assert back.select(F.count("i"), F.sum(F.length("t"))).first()[:] == (400, 40_000_000)
    part = pa.RecordBatch.from_pydict({"t": ["字" * 100_000] * 200})
    assert max(s.num_rows for s in slices(part)) * 300_000 <= 2 * MOST_BYTES


# 1


def test_pieces_cover_the_text(spark):
    draw = random.Random(1)
    texts = ["".join(draw.choice("字a 。\n，\r😀́") for _ in range(draw.randrange(400))) for _ in range(150)] + ["字" * 1000, "", "a b " * 99]
    for text in texts:
        for limit, overlap in ((40, 7), (100, 0), (31, 30)):
            cut = splitting.spans(text, limit, overlap)
            assert "".join(text[a + (overlap if k else 0) : b] for k, (a, b) in enumerate(cut)) == text
            assert all(b - a <= limit for a, b in cut)
            assert all(x[1] - y[0] == overlap for x, y in itertools.pairwise(cut))


def test_pieces_end_at_boundaries(spark):
    df = spark.createDataFrame([(1, "甲。" * 30, "x"), (2, None, "y"), (3, "短", "z"), (1, "甲。" * 30, "w")], "ord int, full_text string, text string")
    limits = spark.createDataFrame([("a", 21, 4), ("b", None, 1), ("c", 500, None)], LIMITS)
    rows = splitting.split_oversized(df, "ord", "full_text", limits).collect()
    assert {r["limit_name"] for r in rows} == {"a"}
    assert all(r["text"].endswith("。") for r in rows)
    assert splitting.split_oversized(df, "ord", "full_text", limits, keep_small=True).where("limit_name = 'c' and n_pieces = 1").count() == 3
    with pytest.raises(ValueError, match="overlap"):
        splitting.spans("abcdef", 3, 3)


# 2


def test_components_against_union_find(spark):
    draw = random.Random(2)
    edges = [(f"n{draw.randrange(60):02}", f"n{draw.randrange(60):02}") for _ in range(45)] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(30)] + [("h", f"s{i:03}") for i in range(80)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    for few in (0, 10**6):
        got = {r["node"]: r["component"] for r in grouped_split.components(spark.createDataFrame(edges, "a string, b string"), few_edges=few).collect()}
        assert got == {x: find(x) for x in linked}


def test_heads(spark):
    text = "指令\n负责人：张三 / 李 四\n指导专家：王五\n课题组成员：赵六\n本课题由 钱七、孙八主持。\n【课题主持人】周九\n项目主持　吴十；郑一\nLed by 冯二 and 陈三\n主持工作很忙"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    assert [sorted(r[0]) for r in df.select(grouped_split.heads(F.col("t"))).collect()] == [sorted("张三 李四 钱七 孙八 周九 吴十 郑一 冯二 陈三".split()), []]


SAMPLE = "sample_id bigint, messages array<struct<role:string,content:string>>, meta struct<doc_id:string,safe_doc_id:string,seed_stem:string,seed_path:string,title:string,n_chunks:int,source_chars:int,target_chars:int>"


def sample(key, doc, user=None, answer=None):
    messages = None if user is None and answer is None else [("system", "s"), ("user", user), ("assistant", answer)]
    return key, messages, None if doc is None else (doc, None, None, None, None, 1, 1, 1)


def test_groups_and_split(spark):
    rows = [
        sample(1, "ab001-2020-0000001", "x\n负责人：张三"), sample(2, "0000002", "x\n主持人：张 三"), sample(3, "ＣＤ００２ 2021 0000003"), sample(4, None, "x"),
        sample(5, None, "x\n负责人：李四"), sample(6, "zz999_2020_0000009（修订）"), sample(6, "zz999_2020_0000009（修订）"), sample(7, "kein"),
    ]
    samples = spark.createDataFrame(rows, SAMPLE)
    reports = spark.createDataFrame([("CD002-2021-0000002",), ("CD002-2021-0000003.docx",), (None,), ("AB001-2020-0000001",)], "doc_id string")
    got = {r["sample_id"]: r["group_key"] for r in grouped_split.sample_groups(samples, reports).collect()}
    assert got == {1: "AB001", 2: "AB001", 3: "AB001", 4: None, 5: None, 6: "ZZ999", 7: None}
    shares = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split_name string, share double")
    split = grouped_split.grouped_split(samples, reports, shares).collect()
    assert len({r["split_name"] for r in split if r["sample_id"] in (1, 2, 3)}) == 1
    assert len(split) == len(rows)


def test_hot_joins(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else "hot" if i % 2 else f"k{i % 40}", "x") for i in range(400)], "id int, key string, v string")
    values = spark.createDataFrame([("hot", 1), ("k2", 2), ("k4", None), ("zz", 3)], "key string, value int")
    for share in (0.0, 0.2, 1.0):
        for keep in (False, True):
            want = sorted(map(tuple, rows.join(values, "key", "left" if keep else "inner").select("id", "key", "v", "value").collect()))
            assert sorted(map(tuple, hot.join_hot(rows, values, "key", keep, share).select("id", "key", "v", "value").collect())) == want
    assert not hot.join_hot(rows.limit(0), values, "key", True).collect()


def test_a_unit_with_a_third_of_all_rows_stays_spread(spark):
    """The records of a hot entity and the neighbours of a hub are joined where they are."""
    names = F.when(F.col("id") % 3 == 0, F.array(F.lit("0:HUB"), F.concat(F.lit("1:"), F.col("id").cast("string")))).otherwise(F.array(F.concat(F.lit("0:"), (F.col("id") % 5000).cast("string"))))
    records = spark.range(0, 300_000, 1, 8).select("id", names.alias("es"))
    found = grouped_split.linked_groups(records, "id", "es")
    parts = [n for n, in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(parts) == 300_000
    assert max(parts) < 0.2 * 300_000
    assert found.where("component = '0:HUB'").count() == 100_000


def test_many_entities_and_long_names(spark):
    many = [f"e{i:06}" for i in range(3000)]
    df = spark.createDataFrame([(1, many), (2, ["e002999", None]), (3, ["x" * 500, "e000000"]), (4, ["x" * 500]), (5, None), (6, [])], "id int, es array<string>")
    got = {r["id"]: r["component"] for r in grouped_split.linked_groups(df, "id", "es").collect()}
    assert got == {1: "e000000", 2: "e000000", 3: "e000000", 4: "e000000", 5: None, 6: None}


def test_shares_hold_with_a_hot_group(spark):
    rows = [sample(i, "HH001-2020-1000000" if i % 3 == 0 else f"AA{i % 400:03}-2020-{i:07}") for i in range(2000)]
    samples = spark.createDataFrame(rows, SAMPLE)
    shares = spark.createDataFrame([("train", 0.8), ("valid", 0.1), ("test", 0.1)], "split_name string, share double")
    got = {r["split_name"]: r["count"] for r in grouped_split.grouped_split(samples, spark.createDataFrame([], "doc_id string"), shares).groupBy("split_name").count().collect()}
    assert abs(got["train"] / 2000 - 0.8) < 0.05
    assert min(got.values()) > 100


# 3


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance():
    draw = random.Random(4)
    for _ in range(400):
        a = "".join(draw.choice("abc") for _ in range(draw.randrange(40)))
        b = "".join(draw.choice("abc") for _ in range(draw.randrange(40))) if draw.random() < 0.5 else "".join(c for c in a if draw.random() < 0.9)
        bound = draw.randrange(20)
        true = distance(a, b)
        assert overlap.banded_distance(a, b, bound) == (true if true <= bound else None)
        assert not (overlap.too_far(a, b, bound) and true <= bound)


def varied(draw, text, share):
    return "".join("" if draw.random() < share / 2 else draw.choice("甲乙丙") if draw.random() < share / 2 else c for c in text)


def overlapping(draw, n=40):
    alphabet = [chr(0x4E00 + i) for i in range(400)]
    base = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(150, 300))) for _ in range(n)]
    train = [(i, [("user", f"写\n【原文】\n负责人：甲\n{t}"), ("assistant", t[:60] + "答")], None) for i, t in enumerate(base)]
    valid = []
    for i, t in enumerate(base):
        share = draw.choice([0.0, 0.02, 0.05, 0.1, 0.15, 0.3, 0.6])
        valid.append((1000 + i, [("user", f"请概括\n{varied(draw, t, share)}"), ("assistant", t[:60] + "。答")], None))
    return train, valid


def test_exact_join_loses_nothing(spark):
    draw = random.Random(7)
    train, valid = overlapping(draw)
    train += [(500, None, None), (501, [("user", "x\ny"), ("assistant", None)], None), (502, *train[0][1:])]
    t, v = (spark.createDataFrame(r, SAMPLE) for r in (train, valid))
    text = lambda m: "".join(overlap.compared(next((c for r, c in m if r == "user"), None), next((c for r, c in m if r == "assistant"), None)))
    near = {
        (a[0], b[0])
        for a, b in itertools.product((x for x in train if x[1] and x[1][1][1]), valid)
        if distance(text(a[1]), text(b[1])) <= int(0.2 * max(len(text(a[1])), len(text(b[1]))))
    }
    assert {(r["sample_a"], r["sample_b"]) for r in overlap.overlap_pairs(t, v).collect()} == near
    classes = {r["sample_id"]: r for r in overlap.overlap_classes(t, v).collect()}
    assert classes[502]["class_id"] == 0
    assert 500 not in classes


def test_query_finds_scattered_edits(spark):
    """As the query calls it: an edit in every ten characters leaves no longer stretch as it was."""
    draw = random.Random(12)
    text = lambda n: "".join(chr(0x4E00 + draw.randrange(900)) for _ in range(n))
    edited = lambda t, every: "".join("换" if i % every == every - 1 else c for i, c in enumerate(t))
    base = [(text(300), text(120)) for _ in range(6)] + [(text(200).replace("换", ""), "a plain answer in a language with spaces " * 3)]
    row = lambda k, s, a: (k, [("user", f"写\n{s}"), ("assistant", a)], None)
    t = spark.createDataFrame([row(i, *x) for i, x in enumerate(base)], SAMPLE)
    v = spark.createDataFrame([row(100 + i, edited(s, 10), edited(a, 10)) for i, (s, a) in enumerate(base)] + [row(200 + i, edited(s, 3), edited(a, 3)) for i, (s, a) in enumerate(base)], SAMPLE)
    found = overlap.overlap_pairs(t, v).select("sample_a", "sample_b").collect()
    assert sorted(map(tuple, found)) == [(i, 100 + i) for i in range(len(base))]


def test_short_samples_have_links(spark):
    row = lambda k, s, a: (k, [("user", f"写\n{s}"), ("assistant", a)], None)
    t = spark.createDataFrame([row(1, "短的原文", "一个回答"), row(2, "乙丙丁", "甲"), row(3, "甲乙丙丁戊己庚辛壬", "子丑寅卯辰巳"), row(4, "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往", "秋收冬藏闰余成岁律吕调阳云")], SAMPLE)
    v = spark.createDataFrame([row(11, "短的原文", "一个回答"), row(12, "乙丙", "丁甲"), row(13, "甲乙丙丁戊己庚辛", "子丑寅卯辰午"), row(14, "天地玄黄宇宙洪荒日月盈昃辰宿列寒来暑往", "秋收冬藏闰余成岁律吕调阳"), row(15, "别的东西", "没有关系")], SAMPLE)
    found = overlap.overlap_pairs(t, v).select("sample_a", "sample_b").collect()
    assert sorted(map(tuple, found)) == [(1, 11), (2, 12), (3, 13), (4, 14)]


def test_filters_lose_nothing():
    draw = random.Random(13)
    for _ in range(400):
        a = "".join(draw.choice("abcd甲乙") for _ in range(draw.randrange(1, 90)))
        b = varied(draw, a, draw.choice([0.05, 0.1, 0.3])) or "b"
        k = distance(a, b)
        assert int(np.bitwise_count(overlap.signature(a) ^ overlap.signature(b)).sum()) <= 2 * k - abs(len(a) - len(b))
        assert not overlap.grams_too_far(overlap.placed_grams(a), overlap.placed_grams(b), k)


@pytest.mark.parametrize("letters", ["ab", "甲乙丙丁戊己庚辛壬癸", "".join(map(chr, range(0x4E00, 0x4F00)))])
def test_segments_lose_nothing(letters):
    draw = random.Random(17)
    text = lambda n: "".join(draw.choice(letters) for _ in range(n))
    valid = [text(draw.randrange(1, 120)) for _ in range(60)] + ["", "a"]
    train = [varied(draw, y, draw.choice([0.0, 0.05, 0.1, 0.2, 0.25])) for y in valid for _ in range(4)] + [y[:i] + text(draw.randrange(30)) + y[i:] for y in valid for i in (0, len(y) // 2, len(y))]
    index = SegmentIndex(valid, 0.2)
    flags = index.candidates(train)
    for (i, x), (j, y) in itertools.product(enumerate(train), enumerate(valid)):
        if overlap.banded_distance(x, y, int(0.2 * max(len(x), len(y)))) is not None:
            assert flags[i, j], (x, y)
    found = {(a, b) for i, j in index.pairs(train) for a, b in zip(i.tolist(), j.tolist())}
    assert found == set(zip(*map(np.ndarray.tolist, np.nonzero(flags))))
    if len(letters) > 200:
        assert flags.sum() < 0.2 * flags.size


def test_moved_sentences_do_not_differ(spark):
    draw = random.Random(9)
    parts = ["".join(chr(0x4E00 + draw.randrange(3000)) for _ in range(40)) + "。" for _ in range(8)]
    row = lambda k, ps, answer: (k, [("user", "写\n" + "".join(ps)), ("assistant", answer)], None)
    t = spark.createDataFrame([row(1, parts, "答案" * 20)], SAMPLE)
    v = spark.createDataFrame([row(11, [*parts[4:], *parts[:4]], "答案" * 20), row(12, parts, "别的" * 20), row(13, [*parts[5:], *parts[5:]], "答案" * 20)], SAMPLE)
    assert [(r["sample_a"], r["sample_b"], r["edits"]) for r in overlap.overlap_pairs(t, v).collect()] == [(1, 11, 0)]


def test_all_pairs_of_the_small_tables(spark, data):
    """The parameters of the query against all pairs of the small tables."""
    t, v = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("sft_train", "sft_valid"))

    def texts(df):
        out = {}
        for r in df.where("messages is not null").collect():
            said = {m["role"]: m["content"] for m in r["messages"]}
            source, answer = overlap.compared(said.get("user"), said.get("assistant"))
            if source and answer:
                out[r["sample_id"]] = source + answer
        return out

    a, b = texts(t), texts(v)
    near = {(i, j) for i, j in itertools.product(a, b) if overlap.banded_distance(a[i], b[j], int(0.2 * max(len(a[i]), len(b[j])))) is not None}
    assert {(r["sample_a"], r["sample_b"]) for r in overlap.overlap_pairs(t, v).collect()} == near
    assert near


# 4


def repeated(sections, width=20):
    values = ["".join(c for c in v or "" if unicodedata.category(c).startswith("L")) for v in (sections or {}).values()]
    text = "\0".join(values)
    seen, cover = set(), [False] * len(text)
    for i in range(len(text) - width + 1):
        w = text[i : i + width]
        if "\0" not in w:
            if w in seen:
                cover[i : i + width] = [True] * width
            seen.add(w)
    return sum(cover), sum(map(len, values))


def test_repetition_against_brute_force(spark, data):
    draw = random.Random(6)
    cases = [{}, None, {"a": None}, {"a": ""}, {"a": "短"}, {"a": "字" * 50}, {"a": "1. 。" * 50}]
    for _ in range(60):
        part = "".join(draw.choice("甲乙丙丁😀é") for _ in range(draw.randrange(15, 40)))
        cases.append({"a": "".join(draw.choice([part, part[:19], "，1", "x" * 7]) for _ in range(draw.randrange(6))), "b": draw.choice([part, None, "z"])})
    df = spark.createDataFrame([(i, c, "e") for i, c in enumerate(cases)], "ord int, sections map<string,string>, n_letters string")
    rows = {r["ord"]: r for r in repetition.repetition_report(df).collect()}
    for i, c in enumerate(cases):
        covered, n = repeated(c)
        assert abs(rows[i]["repeated_share"] - (covered / n if n else 0)) < 1e-5, c
        assert rows[i]["repeated_content"] == (n > 0 and covered / n >= 0.3 - 1e-9)
    real = spark.read.parquet(f"{data}/reports_sections.parquet")
    found = {r["ord"] for r in repetition.repetition_report(real).where("repeated_content").collect()}
    assert found == {r["ord"] for r in real.collect() if (x := repeated(r["sections"]))[1] and x[0] / x[1] >= 0.3}


def test_a_letter_after_a_round_code_is_no_break(spark):
    cases = [{"a": "最Apple手机开App一a需Zoom退q耀x" * 6}, {"a": "最Apple手机开App一a需Zoom退q" * 2, "b": "最Apple手机开App一a需Zoom退q"}]
    df = spark.createDataFrame(list(enumerate(cases)), "ord int, sections map<string,string>")
    for r in repetition.repetition_report(df).collect():
        covered, n = repeated(cases[r["ord"]])
        assert abs(r["repeated_share"] - covered / n) < 1e-5


def test_repetition_beyond_a_million_letters(spark):
    draw = random.Random(8)
    tail = "".join(chr(0x4E00 + draw.randrange(8000)) for _ in range(5000))
    text = "".join(chr(0x4E00 + draw.randrange(20000)) for _ in range((1 << 20) + 100)) + tail * 101
    r = repetition.repetition_report(spark.createDataFrame([(1, {"a": text})], "ord int, sections map<string,string>")).first()
    assert abs(r["repeated_share"] - 500_000 / len(text)) < 1e-5
    assert r["repeated_content"]


def test_stop_words_count_in_every_text(spark):
    """Whether or not a text has the word "the" between blanks."""
    texts = [
        "A report of costs and aims for schools in towns, with plans by teachers",
        "The\nplan was for schools", "of the, and the\nend", "All of the schools", "学校 report of 教师 and 学生", "Zoom apps", "AND by WHEN",
    ]
    counts = [7, 3, 4, 2, 2, 0, 3]
    df = spark.createDataFrame([(i, {"a": t}) for i, t in enumerate(texts)], "ord int, sections map<string,string>")
    for r in repetition.repetition_report(df).collect():
        letters = sum(map(str.isalpha, texts[r["ord"]]))
        assert abs(r["stop_word_share"] - counts[r["ord"]] / letters) < 1e-5, texts[r["ord"]]
        assert r["no_stop_words"] == (counts[r["ord"]] == 0)


# 5


def test_look_alikes(spark):
    rows = [
        (1, "Café 行动", None), (2, "Café ⾏动", ""), (3, "Cafe 行动", " "), (4, "Ｃａｆé　行​动", "a\r\nb"), (5, "Сafé 行动", "a\nb"), (6, "x²", "①"),
        (7, "x2", "1"), (8, None, "А"), (9, "Café 行动", "A"), (10, "​", "Α"), (11, "﻿", "a"),
    ]
    df = spark.createDataFrame(rows, "ord int, title string, full_text string").withColumn("value", F.lit("clash")).withColumn("id", F.lit(0))
    got = {tuple(r) for r in lookalikes.look_alike_pairs(df).collect()}
    titles = {("title", a, b) for a, b in itertools.combinations((1, 2, 4, 5, 9), 2)} - {("title", 1, 9)}
    assert got == titles | {("full_text", 4, 5), ("full_text", 8, 9), ("full_text", 8, 10), ("full_text", 9, 10)}
    one = {r["ord"]: r["title"] for r in lookalikes.one_form(df, "ord", ("title", "full_text")).collect()}
    assert len({one[k] for k in (1, 2, 4, 5, 9)}) == 1
    assert one[3] == "Cafe 行动"
    assert one[8] is None


def test_repeated_identifiers_keep_their_values_apart(spark):
    rows = [(1, "Ａ行"), (1, "乙乙"), (2, "A行"), (2, "A行"), (3, "丙"), (3, None)]
    df = spark.createDataFrame(rows, "ord int, t string")
    assert sorted(map(tuple, lookalikes.look_alike_pairs(df, "ord", ("t",)).collect())) == [("t", 1, 2), ("t", 1, 2)]
    members = lookalikes.look_alike_members(df, "ord", ("t",))
    assert tuple(lookalikes.class_report(members).first()) == ("t", 1, 3, 2)


def test_values_without_a_partner_are_composed(spark):
    draw = random.Random(21)
    texts = ["cafe\u0301", "e\u0302\u0301x", "\u0301a", "か\u3099き", "o\u0302x\u0308", None, "", "plain 字"] + ["".join(draw.choice("aeionū字か \u0301\u0302\u0308") for _ in range(12)) + str(i) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "ord int, t string").withColumn("_form_0", F.lit("clash"))
    got = {r["ord"]: r["t"] for r in lookalikes.one_form(df, "ord", ("t",)).collect()}
    composed = [unicodedata.normalize("NFC", t) if t is not None else None for t in texts]
    ordered = [t is not None and unicodedata.normalize("NFD", t) == "".join(unicodedata.normalize("NFD", c) for c in t) for t in texts]
    assert {i: got[i] for i, fine in enumerate(ordered) if fine} == {i: composed[i] for i, fine in enumerate(ordered) if fine}
    assert got[0] == "caf\xe9"
    assert got[5] is None


# 6

ASK = "请依次写出研究问题、核心概念、研究目标和内容、研究成果、研究效果五个部分。\n【原文】\n"
SOURCE = "课堂观察表明学生在合作学习中逐步形成了表达习惯，教师据此调整了提问的方式和节奏，并在期末整理成册。"
GOOD = "\n".join(f"{p}：{b}" for p, b in zip(pairs.PARTS["zh"], ("怎样提高表达。", "合作学习。", "调整提问。", "形成手册。", "习惯变好。")))


@pytest.mark.parametrize(
    ("answer", "wanted"),
    [
        (GOOD, None), (GOOD[:-1] + "！", None), (None, "empty"), ("", "empty"), (" ​。", "empty"), ("（空）", "empty"), ("N/A", "empty"), ("研究问题：\n核心概念：", "empty"),
        ("对不起，我无法完成这项任务。", "refusal"), ("I'm sorry, but I can't help with that.", "refusal"), (SOURCE, "copy"), ("研究问题：" + SOURCE, "copy"),
        ("The teachers changed the way of asking and the pupils formed a habit of speaking in the lessons.", "wrong_language"), ("Les élèves ont modifié le projet et les tuteurs ont relu le carnet.", "wrong_language"),
        (GOOD.rsplit("\n", 1)[0], "truncated"), (GOOD[:-3], "truncated"), (GOOD.replace("习惯变好。", ""), "truncated"), (GOOD[:-1] + "（见上", "truncated"), (GOOD[:-1] + "（见上）", None),
    ],
)
def test_defects(answer, wanted):
    assert pairs.defect(ASK + SOURCE, answer, pairs.refusal_automaton()) == wanted


@pytest.mark.parametrize(
    ("answer", "wanted"),
    [
        ("抱歉，我无法完成这项任务。" + "原文涉及尚未公开的调查数据，处理它们需要先得到学校的同意，而同意书并没有附在材料里，" * n + "请补齐以后再试。", "refusal") for n in (1, 3, 9)
    ] + [
        ("研究问题：抱歉，我不便回答。" + "原因是材料不全，需要另行补充说明以后才能处理。" * 8, "refusal"),
        ("感谢提问。这个问题我不便回答，" + "因为材料里写到的几所学校还没有同意公开它们的数据" * 4 + "。", "refusal"),
        (GOOD.replace("调整提问。", "学生坦言“抱歉，我无法回答”，教师调整提问。"), None),
        ("概念界定依次展开，" * 20 + "有的学生无法回答追问。", None),
        ("研究问题：\n" * 30, "empty"),
    ],
)
def test_refusals_of_any_length(answer, wanted):
    assert pairs.defect("请写出研究问题。" if wanted is None and "概念界定" in answer else ASK + SOURCE, answer, pairs.refusal_automaton()) == wanted


def test_defects_of_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [("user", ASK)]), (4, [("assistant", GOOD)]), (5, [("user", None), ("assistant", GOOD)]), (6, [("user", "Write a summary."), ("assistant", "Die Gruppen haben das Projekt nicht geprüft und der Plan ist im Lesen.")])]
    rows += [(7, [("user", ASK + SOURCE), ("assistant", GOOD), ("user", "Please answer in one sentence."), ("assistant", "The pupils learned to speak in the lessons.")]), (8, [("user", ASK + SOURCE), ("assistant", GOOD), ("user", "再简短一些。"), ("assistant", SOURCE)])]
    df = spark.createDataFrame(rows, "sample_id int, messages array<struct<role:string,content:string>>")
    wanted = {1: "empty", 2: "empty", 3: "empty", 4: None, 5: None, 6: "wrong_language", 7: None, 8: "copy"}
    assert {r["sample_id"]: r["defect"] for r in pairs.pair_defects(df).collect()} == wanted


def test_suffix_automaton_against_substrings():
    draw = random.Random(8)
    for _ in range(200):
        prompt, answer = ("".join(draw.choice("ab") for _ in range(draw.randrange(1, 25))) for _ in range(2))
        cover = [False] * len(answer)
        for i, j in itertools.combinations(range(len(answer) + 1), 2):
            if j - i >= 4 and answer[i:j] in prompt:
                cover[i:j] = [True] * (j - i)
        assert pairs.SuffixAutomaton(prompt).covered(answer, 4) == sum(cover)


# 7


def test_leaks(spark):
    passage = "访谈中双语试点班坦言教具记录的评价主体明显改观，希望压实责任分工；统计显示复式教学班的得分率有所上升。"
    other = "The graduates measured a bilingual music album regularly, and the shared notes needed another look before the holidays."
    half = passage[:30]
    docs = [
        (100, "前文。" + passage + "后文"), (101, passage.replace("，", ", ").replace("试点", "實驗")), (102, "x" + half + "y"), (103, passage[:14]), (104, None), (105, ""),
        (106, other.upper()), (107, other.replace("music", "dance")), (108, "The graduates measured a bilingual poem."), (109, passage[:20] + "中间无关的话很多很多很多" + passage[25:]), (100, "前文。" + passage + "后文"),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("passage", F.lit("clash"))
    items = spark.createDataFrame([(1, passage), (2, other), (3, None), (4, ""), (5, "短")], "item_id bigint, passage string")
    got = sorted((r["item_id"], r["doc_id"]) for r in leakage.find_leaks(d, items).collect())
    assert got == [(1, 100), (1, 100), (1, 101), (1, 102), (1, 109), (2, 106), (2, 107)]
    assert got == sorted((r["item_id"], r["doc_id"]) for r in leakage.find_leaks(d, items, windows_per_pass=60).collect())
    assert {r["doc_id"] for r in leakage.decontaminate(d, items).collect()} == {103, 104, 105, 108}
    clean = {r["doc_id"]: r["text"] for r in leakage.decontaminate(d.dropDuplicates(["doc_id"]), items, "spans").collect()}
    assert clean[100] == "前文。。后文"
    assert clean[103] == passage[:14]
    assert clean[104] is None
    again = sorted(map(tuple, leakage.decontaminate(d, items, "spans").collect()), key=str)
    assert again == sorted(map(tuple, leakage.decontaminate(d, items, "spans", windows_per_pass=60).collect()), key=str)
    assert len(again) == len(docs)


def test_leaks_of_the_small_tables_against_a_plain_alignment(spark, data):
    """Blocks that both texts have in the same order, of all pairs that share a fair part of their grams of six."""
    docs, items = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "heldout_items"))
    texts = [(r["doc_id"], leakage.normal(r["text"])) for r in docs.where("text is not null").collect()]
    wanted = set()
    for r in items.where("passage is not null").collect():
        x = leakage.normal(r["passage"])
        grams = {x[i : i + 6] for i in range(len(x) - 5)}
        for key, text in texts:
            if sum(g in text for g in grams) >= 0.15 * len(grams):
                blocks = difflib.SequenceMatcher(None, x, text, autojunk=False).get_matching_blocks()
                if sum(b.size for b in blocks if b.size >= (12 if x.isascii() else 5)) >= 0.5 * len(x):
                    wanted.add((r["item_id"], key))
    assert {(r["item_id"], r["doc_id"]) for r in leakage.find_leaks(docs, items).collect()} == wanted
    assert wanted


# 8


def test_budgets():
    leaves = [(("a", "x"), 0.5, 10.0), (("a", "y"), 0.2, 100.0), (("b", "z"), 0.3, 100.0)]
    given = mixing.budgets(leaves, 100.0)
    assert given == pytest.approx({("a", "x"): 10.0, ("a", "y"): 60.0, ("b", "z"): 30.0})
    assert sum(mixing.budgets(leaves, 500.0).values()) == 210.0
    assert mixing.budgets([], 10.0) == {}


def test_mix(spark):
    rows = [(i, "字" * (5 + i % 7), "zh" if i % 2 else "EN", s) for i, s in enumerate(["big"] * 900 + ["small"] * 60 + ["other"] * 30 + [None] * 10)] + [(5000, None, "zh", "big"), (5001, "", None, "big")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("none", 0.1, 1), (None, 0.1, 1)], "source string, target_share double, max_repeat int")
    mixed = mixing.mix(docs, targets)
    got = mixed.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs, targets).collect()))
    assert len({r["doc_id"] for r in got}) == len(got)
    assert max(r["copies"] for r in got) <= 3
    assert {r["source"] for r in got} == {"big", "small"}
    share = {r["source"]: r for r in mixing.mix_report(mixed, targets.where("source is not null")).collect()}
    assert abs(share["small"]["actual_share"] - 0.4) < 0.03
    assert share["none"]["tokens"] == 0
    fixed = {r["source"]: r["tokens"] for r in mixing.mix_report(mixing.mix(docs, targets, total_tokens=1000), targets).collect()}
    assert 850 <= sum(fixed.values()) <= 1000


def test_a_leaf_takes_a_prefix_of_its_order(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("字"), (F.col("id") % 9 + 1).cast("int")).alias("text"), F.lit("zh").alias("lang"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeat int")
    total = 3000
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, targets, total).collect()}
    epoch, bucket = F.lit(0), F.pmod(F.xxhash64(F.lit(42), F.lit(0), "doc_id"), F.lit(mixing.BUCKETS)).cast("int")
    for source in "ab":
        rows = mixing.with_tokens(docs.where(F.col("source") == source)).withColumn("b", bucket).withColumn("h", F.xxhash64(F.lit(42), "doc_id", epoch)).collect()
        size = sum(r["tokens"] for r in rows)
        assert size > total / 2
        used, wanted = 0, set()
        for r in sorted(rows, key=lambda r: (r["b"], r["h"], r["doc_id"])):
            used += r["tokens"]
            if used > total // 2:
                break
            wanted.add(r["doc_id"])
        assert {k for k in got if (k % 3 == 0) == (source == "a")} == wanted
    assert set(got.values()) == {1}


def test_shortages_reach_siblings_first(spark):
    texts = [(i, "字" * 10, "zh", s) for i, s in enumerate(["journal"] * 5 + ["bulletin"] * 100 + ["forum"] * 100)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string")
    targets = spark.createDataFrame([("journal", 0.4, 2), ("bulletin", 0.2, 1), ("forum", 0.4, 1)], "source string, target_share double, max_repeat int")
    tokens = mixing.with_tokens(docs).first()["tokens"]
    got = {r["source"]: r["tokens"] // tokens for r in mixing.mix_report(mixing.mix(docs, targets, 100 * tokens), targets).collect()}
    assert got == {"journal": 10, "bulletin": 50, "forum": 40}


# 9

FOUND = {
    "电话13812345678，邮箱a.b@x-y.com。": ["phone", "email"],
    "拨+86 138-1234-5678或(010) 8123 4567转12": ["phone", "phone"],
    "一三八一二三四五六七八": ["phone"],
    "a.b（at）x.com与c[at]d[dot]org": ["email", "email"],
    "身份证号110101199003071234，旧号110101 19900307 123X": ["id_number", "id_number"],
    "订单110101199013401234，编号20211130001，13 5000 8000": [],
    "证件1101**********123X": [],
    "住在新城区长安路12号3幢2单元501，不在长安路两侧": ["address"],
    "寄到石磨村4组22号": ["address"],
    "会议室在三号楼二层": [],
    "联系人：欧阳文静；老师来了": ["person"],
    "听课人签名：沈骥鸢联系方式见后，听课人签名：濮阳茗珩从八名教师": ["person", "person"],
    "沈老师与陆主任出席": [],
    "本案例由王小明、李思思共同记录。": ["person", "person"],
    "Ask Tormund Quorley (t@q.org) at 12 Old Orchard Road, Apt 4B.": ["person", "email", "address"],
    "Mr. Quorley walked along Old Orchard Road.": [],
    "采用3@5方式，记为V2@校本。": [],
    "": [],
}


@pytest.mark.parametrize("text", FOUND)
def test_personal(text):
    assert [k for _, _, k in personal.occurrences(text, personal.anchors())] == FOUND[text]


def test_long_local_parts_and_house_numbers():
    known = personal.anchors()
    for n in (1, 5, 60):
        mail = ".".join(["abc-d"] * n) + "@x.org"
        house = "石磨村第四村民小组" + "一" * n + "百二十三号"
        for text, kind in ((f"写信到{mail}。", "email"), (f"-_{mail}", "email"), (f"寄到{house}。", "address")):
            assert [(text[a:b], k) for a, b, k in personal.occurrences(text, known)] == [(mail if kind == "email" else house, kind)]
    assert personal.occurrences("a_" * 40000 + "_@x.org", known) == []


def test_masking_leaves_the_rest(spark):
    df = spark.createDataFrame([(1, "甲，电话１３８１２３４５６７８。乙", "k"), (2, None, None), (3, "", "k"), (1, "甲，电话１３８１２３４５６７８。乙", "k")], "doc_id bigint, text string, kind string")
    assert [r["text"] for r in personal.mask_personal(df).collect()] == ["甲，电话[PHONE]。乙", None, "", "甲，电话[PHONE]。乙"]
    rows = [tuple(r) for r in personal.find_personal(df).select("doc_id", "kind", "seq").collect()]
    assert rows == [(1, "phone", 1)] * 2
    long = spark.createDataFrame([(1, "字" * 300000 + "邮箱a@b.cn")], "doc_id bigint, text string")
    assert personal.find_personal(long).first()["start"] == 300002


def test_double_surnames_come_first():
    text = "签名：濮阳茗珩对照量表"
    assert [text[a:b] for a, b, _ in personal.occurrences(text, personal.anchors())] == ["濮阳茗珩"]


def test_common_surnames_are_known():
    known = personal.anchors()
    for surname in "肖洪韦莫关翟覃倪庄齐邢阮庞":
        text = f"如有疑问，联系人：{surname}建国老师。"
        assert [text[a:b] for a, b, kind in personal.occurrences(text, known) if kind == "person"] == [f"{surname}建国"]


def test_composed_and_decomposed_kana_look_alike(spark):
    texts = ["が", "か\u3099", "ガ", "ｶﾞ", "\U0001109a", "\U00011099\U000110ba", "\u2126", "\u03a9"]
    df = spark.createDataFrame(list(enumerate(texts)), "ord int, t string")
    assert sorted((r["ord_a"], r["ord_b"]) for r in lookalikes.look_alike_pairs(df, "ord", ("t",)).collect()) == [(0, 1), (2, 3), (4, 5), (6, 7)]


def test_every_hit_passage_is_verified():
    draw = random.Random(15)
    letters = [chr(0x4E00 + draw.randrange(8000)) for _ in range(120)]
    held = "".join("改" if i > 12 and i % 9 == 0 else c for i, c in enumerate(letters))
    passages = [(1, "".join(letters)), (2, "ashortlatinpassage")]
    windows = leakage.Windows(dict(passages), leakage.window_set(passages, leakage.WINDOW, leakage.LATIN_WINDOW))
    assert [key for key, _, _ in windows("前文" + held + "后文", 0.5)] == [1]
    assert [(key, share) for key, share, _ in windows("before" + "ashortlatinpassage" + "behind", 0.5)] == [(2, 1.0)]
    assert not list(windows("".join(letters[:14]) + "其余都是别的文字" * 9, 0.5))

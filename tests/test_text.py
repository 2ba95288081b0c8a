import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.config import TITLES
from paperloom.functions.headings import looks_like_heading, match_section, normalize_heading
from paperloom.functions.postprocess import cleaned_lines, rebuilt
from paperloom.functions.quality import five_sections, qc_section, qc_summary, split_sections
from paperloom.functions.text import loose_key, normalize_text, safe_filename, strip_title_prefix, visible_length


def run(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def plain(s):
    s = re.sub(" {2,}", " ", (s or "").replace("　", " ").replace("\t", " "))
    return re.sub("\n{3,}", "\n\n", s).strip()


def random_texts(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(" \n\t　 \x1c\x85aB研究😀é。") for _ in range(draw.randrange(30))) for _ in range(n)]


def test_normalize_text(spark):
    values = [None, "", "   ", "a  \n  b", "a\n\n\n\nb", "　x\t\ty　", *random_texts(300)]
    assert run(spark, values, normalize_text) == [plain(v) for v in values]


def test_names_and_keys(spark):
    assert run(spark, ["x:y", "a/b\\c", "t .", None, "长" * 200], lambda c: safe_filename(c, 160)) == ["x_y", "a_b_c", "t", "", "长" * 160]
    assert run(spark, ["É-1 研_究", "!!!", None], loose_key) == ["é1研_究", "", ""]
    assert run(spark, ["研究问题： 甲", "研究问题乙", "丙"], lambda c: strip_title_prefix(c, "研究问题")) == ["甲", "乙", "丙"]
    assert run(spark, ["a b\n　c", None], visible_length) == [3, 0]


def test_headings(spark):
    values = ["一、研究问题：", "（一）核心概念", "第一部分研究成果", "一般问题", "研究成果应用", "成果应用", "随便", "", None]
    assert run(spark, values, normalize_heading)[:4] == ["研究问题", "（一）核心概念", "分研究成果", "般问题"]
    assert run(spark, values, match_section) == ["研究问题", "核心概念", "研究成果", None, "研究成果", "研究效果", None, None, None]
    assert run(spark, ["长" * 25, "长" * 26, " ", None], looks_like_heading) == [True, False, False, False]


def five(text):
    parts = re.split(rf"({'|'.join(TITLES)})\s*[:：]?", plain(text))
    if len(parts) < 11:
        return None
    found = {}
    for k in range(1, len(parts) - 1, 2):
        found[parts[k]] = plain(parts[k + 1])
    return found if all(found.get(t) for t in TITLES) else None


def test_sections_are_cut_at_every_title(spark):
    whole = "\n".join(f"{t}：内容{i}" for i, t in enumerate(TITLES))
    values = [whole, whole.replace("内容1", "关于研究成果的话"), whole.replace("内容3", ""), whole + "\n研究效果：再说", "没有", None, ""]
    assert run(spark, values, five_sections) == [five(v) for v in values]
    assert run(spark, values[2:3], split_sections)[0]["研究成果"] == ""


def test_quality_rules(spark):
    assert run(spark, ["", None, "好", "a", "字" * 300, "字" * 301, "“引", "Ⅳ１"], lambda c: F.array_join(qc_section(c), "|")) == [
        "空段落", "空段落", "", "包含英文或数字（禁用）", "", "本段超过三百字", "包含引号或书名号，疑似引用", "",
    ]
    good = "\n".join(f"{t}：{'字' * 299}" for t in TITLES[:4]) + f"\n{TITLES[4]}：短"
    assert run(spark, ["", good, "甲1"], lambda c: F.array_join(qc_summary(c), "|")) == ["空输出", "", "包含英文或数字（禁用）|未按五段结构输出或标题缺失"]
    long = good.replace("：短", "：" + "字" * 301)
    assert run(spark, [long], lambda c: F.array_join(qc_summary(c), "|")) == ["总字数超限|研究效果 超过三百字"]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("研究问题：：发现甲", "研究问题：甲"),
        ("说:：明", "说：明"),
        ("研究效果：方面 好", "研究效果：好"),
        ("核心概念：方面，好", "核心概念：，好"),
        ("说：，明", "说：明"),
        ("见https://a.b/c?d 好", "见 好"),
        ("见www.x.org好", "见好"),
        ("见abc.com网", "见abc.com网"),
        ("见 abc.com 网", "见 网"),
        ("甲\n\n乙", "甲 乙"),
        (None, ""),
    ],
)
def test_cleaning(spark, text, wanted):
    assert run(spark, [text], lambda c: rebuilt(cleaned_lines(c)))[0].strip() == wanted


def test_cleaning_rebuilds_all_titles(spark):
    text = "\n".join(f"{t}:: 第{i}\n段" for i, t in enumerate(TITLES))
    assert run(spark, [text], lambda c: rebuilt(cleaned_lines(c))) == ["\n".join(f"{t}：第{i} 段" for i, t in enumerate(TITLES))]

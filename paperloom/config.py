"""Constants and fixed texts of the document pipeline. All of them are defaults of parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    heading_chars: int = 25
    title_chars: int = 40
    chunk_chars: int = 2000
    chunk_overlap: int = 600
    dedup_prefix: int = 200
    chunk_tokens: int = 1100
    token_overlap: int = 160
    query_chars: int = 2000
    top_n: int = 16
    mmr_k: int = 6
    mmr_lambda: float = 0.62
    block_chars: int = 2200
    block_slack: int = 50
    budget_tokens: int = 3600
    jitter_drop: float = 0.12
    jitter_most: int = 24
    variants: int = 12
    tip_share: float = 0.20
    sequence: int = 4096
    least_supervised: int = 220
    valid_ratio: float = 0.02
    section_limit: int = 300
    total_limit: int = 1500
    retries: int = 2
    safe_name_chars: int = 160
    seed: int = 42


LIMITS = Limits()

#: Sections in order of priority, each with the aliases that a heading may contain.
TAXONOMY: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("研究问题", ("研究问题", "核心问题", "主要问题", "关键问题", "研究的主要问题", "问题的提出", "问题提出", "存在问题", "问题分析", "问题与对策")),
    ("核心概念", ("核心概念", "概念界定", "相关概念界定", "基本概念界定", "主要概念界定", "术语界定", "名词界定", "核心概念界定", "相关概念", "核心术语界定")),
    ("研究目标和内容", ("研究目标和内容", "研究目标与内容", "研究目标及内容", "研究目的与内容", "研究目标", "研究目的", "研究内容", "主要内容", "研究的主要内容", "研究目标与主要内容", "研究目标与任务", "研究任务", "研究思路与实施内容", "研究过程与内容", "实施内容", "研究计划与内容")),
    ("研究成果", ("研究成果", "主要成果", "阶段成果", "课题成果", "课题研究成果", "研究收获", "研究结论", "主要结论", "研究进展与成果", "创新点", "特色与创新", "成果概述", "研究产出")),
    ("研究效果", ("研究效果", "实施效果", "应用效果", "实践效果", "推广效果", "应用价值", "成果应用", "成果推广", "社会效益", "教学效果", "实施成效", "研究成效", "预期目标达成情况", "课题实施效果", "综合效果")),
)
TITLES: tuple[str, ...] = tuple(name for name, _ in TAXONOMY)

#: Reasons of the quality rules.
EMPTY_SECTION, EMPTY_OUTPUT, EMPTY_DOCUMENT = "空段落", "空输出", "空文档或无法读取"
FORBIDDEN, SECTION_TOO_LONG, TOTAL_TOO_LONG = "包含英文或数字（禁用）", "本段超过三百字", "总字数超限"
PART_TOO_LONG, BAD_STRUCTURE, QUOTES = " 超过三百字", "未按五段结构输出或标题缺失", "包含引号或书名号，疑似引用"
EMPTY_SOURCE = "empty_full_text"

#: Prompts.
STYLE_FULL = "你是一名教育科研报告“主旨提取”助手。请仅依据原文内容，按固定结构输出五段：研究问题、核心概念、研究目标和内容、研究成果、研究效果。硬性约束：一、每段不超过三百字；二、总字数不超过一千五百字；三、不得出现英文、字母、阿拉伯数字或罗马数字；四、不得编造、不得扩展、不得加入原文没有的信息；五、不得引用原文句子（不要出现引号或逐句摘抄），用概括表达；六、语言风格正式、收束、与 seed 样式一致；七、若原文信息不足以支撑某段，仍需用审慎表达给出该段的可证据化概括，不得虚构细节。"
STYLE_EVIDENCE = "你是一名教育科研报告“主旨提取”助手。请仅依据原文证据内容，按固定结构输出五段：研究问题、核心概念、研究目标和内容、研究成果、研究效果。硬性约束：一、每段不超过三百字；二、总字数不超过一千五百字；三、不得出现英文、字母、阿拉伯数字或罗马数字；四、不得编造、不得扩展、不得加入原文没有的信息；五、不得引用原文句子（不要出现引号或逐句摘抄），用概括表达；六、语言风格正式、收束、与 seed 样式一致；七、若原文信息不足以支撑某段，仍需用审慎表达给出可证据化概括，不得虚构细节。"
SYSTEM_FULL = "你是一个严格遵循指令的中文写作模型。输出必须由给定原文直接支撑，且必须完全满足格式与长度约束。"
SYSTEM_EVIDENCE = "你是一个严格遵循指令的中文写作模型。输出必须由给定原文证据直接支撑，且必须完全满足格式与长度约束。"
SOURCE_HEAD, ASK = "【原文】\n", "请开始输出。"
EVIDENCE_INTRO = "以下为从原文中抽取的证据块集合（并非全文）。你必须仅依据这些证据块进行主旨提取，不得补充未出现的信息。\n\n"
QUALITY_TIP = "\n\n【质检提醒】请再次检查：五段齐全；每段三百字内；总字数一千五百字内；不含英文数字与引号书名号。"
SECTION_TASK = (
    "【任务】只输出《{title}》这一段内容。\n【严格要求】\n1）只输出段落内容本身，不要输出其它标题，不要列条目编号；\n2）不得出现英文、字母、阿拉伯数字或罗马数字；\n"
    "3）本段不超过三百字；\n4）不得引用原文句子，不要出现引号或书名号；\n5）只依据下方证据块概括，不得补充未出现信息。\n\n【证据块】\n"
)
SECTION_ASK = "请输出该段。"
RETRY_TIP = ("【质检提醒】你上一版未通过：", "；", "。请严格改正：只输出该段正文，三百字内，不含英文数字与引号书名号。")

"""Problem 6: broken prompt and response pairs.

Each sample gets at most one defect, the first that applies in this order:

* ``empty``: nothing is left of the answer without marks, invisible characters, placeholders and headings;
* ``refusal``: an automaton over refusal phrases finds one, and either the clauses with such phrases are half of what is said, or the answer
  opens with a sentence in which its speaker refuses, however long the reasons behind it, and goes through no more than one of the parts;
* ``wrong_language``: the answer's language, by votes of stop-words and scripts, is not that of the request;
* ``copy``: the answer is traversed over the suffix automaton of the prompt; long stretches of it cover most of the answer;
* ``truncated``: the answer breaks off: parts that were asked for are missing at its end, the last part is empty, or the
  last sentence has no end that the delimiter stack confirms.

Comparisons leave out marks, white space, width and case. The suffix automaton is built where enough aligned blocks of the answer
occur in the prompt; a stretch of ``STRETCH`` characters holds at least one whole block, so nothing that counts is missed.

Defined results: null messages or a missing answer are ``empty``; a missing prompt leaves only the checks of the answer itself.
Of several messages the last assistant message is judged; the last user message is the request, and copying is from all of them. Repeated
rows are each judged.
"""

from __future__ import annotations

import re
import unicodedata

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows

#: The parts a request can ask for, in order, in the languages of the requests.
PARTS = {
    "zh": ("研究问题", "核心概念", "研究目标和内容", "研究成果", "研究效果"),
    "en": ("question", "concepts", "aims", "results", "effects"),
}
#: What stands in for an answer that was never given.
PLACEHOLDERS = (
    "空 无 略 暂无 待补充 待填写 待定 未填写 未提供 暂缺 没有 缺失 内容为空 无内容 此处省略 答案 回答 na n/a null none nil nan todo tbd tba empty blank placeholder xxx undefined"
).split()
#: Openings and cores of refusals.
REFUSALS = (
    "无法完成|无法提供|无法处理|无法回答|无法满足|无法协助|无法帮助|无法生成|无法概括|无法为您|无法按|不能完成|不能提供|不能处理|不能回答|不能根据|不能协助|不能帮助|不能生成|不能为您|没有权限|没有办法|"
    "超出了我的能力|超出我的能力|能力范围|不便回答|不便提供|不方便|恕我|恕难|拒绝|爱莫能助|不予回答|无权|抱歉|对不起|不好意思|"
    "i'm sorry|i am sorry|i can't|i cannot|i can not|i'm unable|i am unable|i won't|unable to|cannot be completed|can't be completed|not able to|cannot help|can't help|cannot assist|can't assist|"
    "decline|as an ai|as a language model|unfortunately this request|not permitted|not allowed|against my|must refuse|"
    "je suis désolé|je ne peux|je regrette|malheureusement|es tut mir leid|ich kann nicht|ich kann diese|kann ich nicht|leider|lo siento|no puedo|申し訳|できません|お答えでき"
).split("|")
#: Frequent function words by language.
STOPWORDS = {
    "en": "the of and to in a was by that is for with on before when while each about neither nor although were are from this than".split(),
    "fr": "le la les de des du et en un une dans que qui ont est au aux sur pour avec chaque cette ce il elle sont".split(),
    "de": "der die das den dem ein eine einen und zu im in mit von haben hat ist nicht auf für wurde sich zeigt einem".split(),
    "es": "el la los las de del y en un una que por con para se es al lo su más han".split(),
}
OPEN, CLOSE = "（(「『“【《[", "）)」』”】》]"
STRETCH, BLOCK, LATIN_STRETCH = 16, 8, 36
COPY_SHARE, REFUSED_SHARE = 0.5, 0.5
#: Words of one who refuses and of the one spoken to; a pupil who "cannot answer" is neither.
SPEAKER = re.compile(r"我|本人|您|你|抱歉|对不起|不好意思|恕|遗憾|作为|\bi\b|\bi'm\b|sorry|\byour?\b|\bas an? |unfortunately|\bje\b|malheureusement|\bich\b|leider|lo siento|no puedo|申し訳|お答え")
SENTENCE, CLAUSE = re.compile(r"[。！？!?;；\n]+|\.(?=\s|\Z)"), re.compile(r"[。！？!?;；，,、：:\n]+|\.(?=\s|\Z)")
MARKS = re.compile(r"[\W_]+")
INVISIBLE = re.compile(r"[­͏؜᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
PART_RE = re.compile(r"(?im)(?:^|(?<=[。！？!?.；;\n]))[ \t　#*【\[（(]*(?:[0-9一二三四五][、.．)） ]*)?[*【\[]*(研究问题|核心概念|研究目标和内容|研究成果|研究效果|(?:research )?questions?|concepts?|aims?|results?|effects?)[*】\]]*[ \t]*(?:[:：]|$)[*]*")
ENDED = re.compile(r"[。！？.!?；;\"']\s*\Z")
CJK = re.compile(r"[㐀-鿿豈-﫿\U00020000-\U0003ffff]")
KANA = re.compile(r"[ぁ-ヿ]")
HANGUL = re.compile(r"[가-힯]")
WORDS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> str:
    return unicodedata.normalize("NFKC", MARKS.sub("", text)).lower()


class SuffixAutomaton:
    """All substrings of a text, built in one pass; states hold their transitions, longest length and suffix link."""

    def __init__(self, text: str):
        self.step, self.long, self.link = [{}], [0], [-1]
        step, long, link, last = self.step, self.long, self.link, 0
        for char in text:
            now = len(step)
            step.append({})
            long.append(long[last] + 1)
            link.append(0)
            at = last
            while at != -1 and char not in step[at]:
                step[at][char] = now
                at = link[at]
            if at != -1:
                to = step[at][char]
                if long[to] == long[at] + 1:
                    link[now] = to
                else:
                    copy = len(step)
                    step.append(dict(step[to]))
                    long.append(long[at] + 1)
                    link.append(link[to])
                    while at != -1 and step[at].get(char) == to:
                        step[at][char] = copy
                        at = link[at]
                    link[to] = link[now] = copy
            last = now

    def covered(self, text: str, least: int) -> int:
        """Characters of a text in stretches of at least ``least`` that occur in the automaton's."""
        state, size, total, end = 0, 0, 0, 0
        for i, char in enumerate(text, 1):
            while state and char not in self.step[state]:
                state = self.link[state]
                size = self.long[state]
            if char in self.step[state]:
                state = self.step[state][char]
                size += 1
            if size >= least:
                total += i - max(end, i - size)
                end = i
        return total


def copied_share(answer: str, prompt: str) -> float:
    """Share of a normalised answer that stands in a normalised prompt, in long stretches."""
    if not answer or not prompt:
        return 0.0
    if len(answer) < STRETCH:
        return float(answer in prompt) if len(answer) >= BLOCK else 0.0
    blocks = range(0, len(answer) - BLOCK + 1, BLOCK)
    if sum(answer[i : i + BLOCK] in prompt for i in blocks) < 0.15 * len(blocks):
        return 0.0
    latin = sum(c.isascii() for c in answer) > len(answer) / 2
    return SuffixAutomaton(prompt).covered(answer, LATIN_STRETCH if latin else STRETCH) / len(answer)


def language(text: str) -> str | None:
    """zh, ja, ko or a language of STOPWORDS; None where nothing tells."""
    cjk, kana, hangul = len(CJK.findall(text)), len(KANA.findall(text)), len(HANGUL.findall(text))
    words = [w.lower() for w in WORDS.findall(CJK.sub(" ", text))]
    if hangul > cjk + len(words):
        return "ko"
    if kana > 0.15 * (cjk + kana) and kana > 5:
        return "ja"
    if cjk >= 2 * len(words):
        return "zh" if cjk else None
    votes = {name: sum(w in own for w in words) for name, own in STOP_SETS.items()}
    best = max(votes, key=lambda v: (votes[v], v == "en"))
    return best if votes[best] else None


STOP_SETS = {k: frozenset(v) for k, v in STOPWORDS.items()}


def closed(text: str) -> bool:
    """Whether a text comes to an end: with the end of a sentence, or with a mark that closes what the delimiter stack holds open.

    A delimiter left open before a finished last sentence is a slip of writing, not a break.
    """
    stack: list[str] = []
    matched = False
    for char in text:
        matched = False
        if char in OPEN:
            stack.append(char)
        elif char in CLOSE:
            mate = OPEN[CLOSE.index(char)]
            if matched := mate in stack:
                while stack.pop() != mate:
                    pass
    if text[-1:] in CLOSE and text[-1:]:
        return matched
    return bool(ENDED.search(text)) and not text.endswith(("...", "…"))


def refusal_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in REFUSALS:
        found.add_word(phrase, len(phrase))
    found.make_automaton()
    return found


def refuses(body: str, refusals: ahocorasick.Automaton) -> bool:
    """Whether a text without its headings refuses: by the share of its refusing clauses, or by how it opens."""
    low = body.lower().replace("’", "'")
    if next(refusals.iter(low), None) is None:
        return False
    told = lambda part: next(refusals.iter(part), None) is not None
    size = lambda part: len(letters(part))
    clauses = CLAUSE.split(low)
    if sum(size(c) for c in clauses if told(c)) >= REFUSED_SHARE * sum(map(size, clauses)):
        return True
    before = 0
    for sentence in SENTENCE.split(low):
        if told(sentence):
            return before <= size(sentence) and SPEAKER.search(sentence) is not None
        before += size(sentence)
    return False


def asked_parts(request: str) -> tuple[str, ...]:
    """The parts that the instruction, the first line of a request, asks for."""
    first = request.strip().split("\n", 1)[0].lower()
    zh = tuple(p for p in PARTS["zh"] if p in first)
    if zh:
        return zh
    return PARTS["en"] if re.search(r"five (?:parts|headings|sections)", first) or all(p[:5] in first for p in PARTS["en"]) else ()


def defect(request: str | None, answer: str | None, refusals: ahocorasick.Automaton, prompt: str | None = None) -> str | None:
    """The defect of an answer; ``prompt`` is all that was said to it where that is more than the request."""
    if answer is None:
        return "empty"
    shown = INVISIBLE.sub("", answer)
    body = PART_RE.sub("\n", shown)
    plain = letters(body)
    kept = plain
    for word in PLACEHOLDERS:
        if kept == letters(word):
            kept = ""
    if not kept or not letters(re.sub("|".join(PARTS["zh"]), "", kept)):
        return "empty"
    if all(letters(x) in PLACE_SET for x in re.split(r"[\n。；;]", body)):
        return "empty"
    given_parts = {m[1].lower() for m in PART_RE.finditer(shown)}
    if len(given_parts) < 2 and refuses(body, refusals):
        return "refusal"
    asked: tuple[str, ...] = ()
    if request and request.strip():
        asked = asked_parts(request)
        first = request.strip().split("\n", 1)[0]
        wanted, given = language(first), language(body)
        if re.search(r"\benglish\b|英文|英语作答", first, re.I):
            wanted = "en"
        if wanted and given and wanted != given:
            return "wrong_language"
        if copied_share(plain, letters(prompt or request)) >= COPY_SHARE:
            return "copy"
    if len(asked) > 1:
        names = {p: any(g.startswith(p.rstrip("s")) or g.endswith(p) for g in given_parts) for p in asked}
        if given_parts and not all(names.values()) or not given_parts:
            return "truncated"
        last = list(PART_RE.finditer(shown))[-1]
        if not letters(shown[last.end() :]):
            return "truncated"
    return None if closed(shown.strip()) else "truncated"


PLACE_SET = frozenset({"", *map(letters, PLACEHOLDERS)})


def pair_defects(samples: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """(<id>, defect) for every sample, null where the answer serves the request."""
    said = lambda role: F.filter("messages", lambda m: m.role == role)
    prompt = F.array_join(F.transform(said("user"), lambda m: F.coalesce(m.content, F.lit(""))), "\n")
    rows = samples.select(F.col(id_col).alias("id"), F.try_element_at(said("user"), F.lit(-1))["content"].alias("request"), F.when(F.size(said("user")) > 1, prompt).alias("prompt"), F.try_element_at(said("assistant"), F.lit(-1))["content"].alias("answer"))

    def start():
        refusals = refusal_automaton()
        return lambda key, request, prompt, answer: ((key, defect(request, answer, refusals, prompt)),)

    kind = rows.schema["id"].dataType.simpleString()
    return map_rows(rows, f"id {kind}, defect string", start).withColumnRenamed("id", id_col)

"""Problem 9: personal information inside free text, replaced by typed placeholders.

One Aho-Corasick automaton finds anchors in a text: at-signs and their spellings, schemes, number openings, the ends of street
addresses and surnames. At each anchor a deterministic local parser expands to the boundaries of the thing and validates it:

* ``email``: local part and domain with a dot around any spelling of the at-sign;
* ``phone``: mobile and fixed-line numbers with prefixes, separators, extensions, wide or spelt-out digits;
* ``id_number``: 17 digits and a digit or X, with a real date of birth;
* ``address``: a street, lane or village with a house number;
* ``person``: a full name, recognised by its surname and by what stands before and behind it.

Where two of them overlap, the earlier and then the longer one counts. The rest of the text stays as it is, character by character.

Defined results: null texts have no occurrences and stay null. Masked numbers, surnames with a title, places without a house
number and other numbers are left alone. Repeated rows are each treated. Other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows

KINDS = ("email", "phone", "id_number", "address", "person")

#: Surnames of two characters, then of one.
DOUBLE_SURNAMES = "欧阳 上官 司马 诸葛 东方 令狐 公冶 钟离 澹台 司徒 尉迟 濮阳 皇甫 长孙 宇文 慕容 夏侯 端木 轩辕 独孤 南宫 闻人 赫连 公孙".split()
SINGLE_SURNAMES = (
    "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
    "佘亓逄郗简麴缑厍鄢蔺游闵卓宓柯晏迟冼鹿訾桑羿虞仉漆郁茹邰岑柏殷俞柳鲍费廉褚卫华严尤施戚窦章云葛奚滕"
    "陶喻郎鲁韦昌苗凤酆倪毕邬安卞齐伍卜穆湛祁禹狄臧谈茅庞纪舒屈祝阮蓝季麻强路娄童颜梅盛刁骆樊凌霍昝莫裘缪宗宣贲杭洪诸左吉钮嵇邢滑裴荣翁荀羊於惠甄芮靳汲邴糜富巫乌焦巴牧隗蓬班仰秋仲伊宫宁仇栾甘钭厉戎符景詹韶郜蓟薄蒲鄂咸籍屠蒙阴"
    "胥苍闻莘党翟贡劳姬申扶堵冉宰郦雍郤璩桂濮牛寿扈燕冀郏浦温庄柴瞿宦戈庾衡耿弘匡寇禄阙东欧殳沃蔚夔巩聂晁冷辛阚饶毋乜鞠关蒯荆竺逯桓肖覃闫付仝岳牟佟苑涂兰邸晋楚褟占揭揣芦邝卿甯苟帅尧栗"
)
#: What stands before a full name, what stands behind one.
BEFORE = (
    "联系人 姓名 签名 登记 写着 写着“ 访谈对象 受访者 家长 学生 持证人 补录 移交给 交给 整理者 记录者 外婆 外公 奶奶 爷爷 母亲 父亲 妈妈 爸爸 缺席的是 提到 提及 由 据 "
    "回访时 散会时 课后 会后 负责人 主持人 作者 记者 同事 班主任 教师 本人 我叫 名叫 感谢 收件人 寄件人 申请人 经办人 监护人 联络人 邀请 请 向 与 和"
).split()
BEHIND = (
    "老师 同学 先生 女士 来信 的祖母 的祖父 的母亲 的父亲 的家长 的家庭 的做法 的意见 的孩子 的 回忆 提出 认为 表示 把 将 与 和 及 代签 代收 收 负责 说 共同 签名 签字 指出 介绍 告诉 申请 等"
).split()
#: What behind a name is enough without anything before it.
SURE_BEHIND = re.compile(r"代签|代收|收[。，；\n]|[（(]{1,2}(?=[+＋0-9０-９（(]|[一二三四五六七八九零〇]{7}|[A-Za-z0-9._-]+ ?(?:@|＠|\(at\)|\[at\]|\[dot\]))|老师留下|[ 　](?=[+0-9０-９(（]{1,5}[0-9０-９ \-—.)）]{6})|[ 　](?=[一二三四五六七八九零〇]{11})")
NOT_GIVEN = set("的了在是我你他她它们这那有不也就都而及与或被把将从对以为着过地得年月日时分号路街区县市省第某老师主任校长教授先生女士书记同学家班级组长一二三四五六七八九十百千两几个多少收说案式面法向便针程位")
TITLES = "老师 主任 校长 教授 先生 女士 书记 同学 师傅 局长 医生 园长 院长 科长 处长 经理 阿姨 大爷".split()

#: Ends of street names and of house numbers; English kinds of streets.
STREETS = "路 街 巷 里 道 弄 村 胡同 坊 庄 屯 寨".split()
ENGLISH_STREETS = "Street Avenue Road Lane Rise Drive Court Square Terrace Close Crescent Boulevard Way Place".split()
NOT_NAMES = set(
    "The A An In On At By For From When Where While Neither Nor About After Before Later Ask Interview Contact Please Dear With And Or But This That These Those He She It They We You I "
    "Phase Project School University College Primary Middle High North South East West Old New Block Apt Unit Room Class Grade Mr Mrs Ms Dr Prof Professor Miss Sir Monday Tuesday Wednesday "
    "Thursday Friday Saturday Sunday January February March April May June July August September October November December Question Concepts Aims Results Effects Table Figure Chapter Section".split()
) | set(ENGLISH_STREETS)

WIDE = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20}
SPELT = dict(zip("零〇一二三四五六七八九幺", "001234567891"))
AT = r"(?:@|\(at\)|\[at\]|（at）|#at#)"
DOT = r"(?:\.|\[dot\]|\(dot\)|（dot）)"
WORD = r"[a-z0-9](?:[a-z0-9_+%-]*[a-z0-9])?"
LOCAL_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
LOCAL_MARKS = LOCAL_LETTERS | set("_+%-")
DOTS = (".", "[dot]", "(dot)", "（dot）")
AT_HERE = re.compile(AT, re.I)
DOMAIN = re.compile(rf" ?{WORD}(?:{DOT}{WORD})*{DOT}[a-z]{{2,}}", re.I)
NUMBER_RUN = re.compile(r"[+(（]?[0-9０-９][0-9０-９ ()（）.\-—－–]*(?:[0-9０-９]|[Xx](?![A-Za-z]))(?:(?:转|ext\.? ?|x)[0-9]{1,6})?")
SPELT_RUN = re.compile(r"[零〇一二三四五六七八九幺]{7,}")
MOBILE = re.compile(r"(?:(?:\(?\+? ?86\)?|0086)[ -]?)?1[3-9](?:[ .-]?[0-9]){9}")
FIXED = re.compile(r"(?:(?:\(?\+? ?86\)?|0086)[ -]?)?(?:\(0[0-9]{2,3}\)|0[0-9]{2,3})[ -]?[2-9][0-9]{2,3}[ -]?[0-9]{4}(?:转[0-9]{1,6})?")
IDENTITY = re.compile(r"[1-9][0-9](?:[ -]?[0-9]){15}[ -]?[0-9Xx]")
NUM = r"(?:[0-9]+|[零〇一二三四五六七八九十百千]+)"
HOUSE = re.compile(
    rf"(?:第?{NUM}(?:村民小组|村民组|组|队|社)|{NUM}弄)?{NUM}(?:-{NUM})?号(?!楼|线|文|令|机|院校|选手|通知)(?:院)?(?:{NUM}(?:栋|幢|座|号楼))?(?:{NUM}单元(?:{NUM})?)?(?:{NUM}(?:室|房|户))?(?:室|房|户)?"
)
HOUSE_LETTERS = frozenset("0123456789零〇一二三四五六七八九十百千第村民小组队社弄-")
#: The longest thing that this matches has fewer than 40 characters.
BEFORE_HOUSE = re.compile(rf"((?:[一-鿿]{{2,3}}[省市县区州盟旗][ ]?){{0,3}}(?:[一-鿿]{{1,6}}(?:镇|乡|街道))?[一-鿿]{{1,4}}(?:{'|'.join(STREETS)})(?:[东南西北]段)?) ?\Z")
LEADING = re.compile(r"^(?:.*(?:登记为|住址[：:]?|地址[：:]?|位于|[寄送搬迁移回来前][到至往]|住[在：:]|居于|或寄|[记写]为)|[寄为在到于住至自从往是](?=..))")
ENGLISH_ADDRESS = re.compile(rf"\b[0-9]{{1,5}}[A-Z]? (?:[A-Z][a-z]+ ){{1,3}}(?:{'|'.join(ENGLISH_STREETS)})\b(?:, (?:Apt|Block|Unit|Flat|Room|Suite|Floor)\.? [0-9A-Z-]+)?")
ENGLISH_NAME = re.compile(r"\b[A-Z][a-z]+(?:-[A-Z][a-z]+)?(?: [A-Z]\.)?(?: [A-Z][a-z]+(?:-[A-Z][a-z]+)?)+\b")


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ("@", "(at)", "[at]", "（at）", "#at#", "(AT)", "[AT]"):
        found.add_word(word, ("@", len(word)))
    for word in ("tel:", "mailto:"):
        found.add_word(word, ("#", 0))
    for a in range(100):
        found.add_word(f"{a:02}", ("#", 2))
    for word in DOUBLE_SURNAMES:
        found.add_word(word, ("n", 2))
    for word in SINGLE_SURNAMES:
        found.add_word(word, ("n", 1))
    for street in ENGLISH_STREETS:
        found.add_word(f" {street}", ("s", len(street) + 1))
    for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        found.add_word(f" {letter}", ("e", 2))
    found.add_word("号", ("h", 1))
    for a in "零〇一幺":
        for b in "零〇一二三四五六七八九":
            found.add_word(a + b, ("c", 2))
    found.make_automaton()
    return found


def real_date(digits: str) -> bool:
    try:
        return 1880 <= date(int(digits[:4]), int(digits[4:6]), int(digits[6:8])).year <= 2030
    except ValueError:
        return False


def local_start(text: str, end: int) -> int:
    """Where the local part that ends at ``end`` begins: words of letters, digits and joining marks with dots between; ``end`` where there is none."""
    at = start = end - (text[end - 1 : end] == " ")
    while at and text[at - 1] in LOCAL_LETTERS:
        while at and text[at - 1] in LOCAL_MARKS:
            at -= 1
        while text[at] not in LOCAL_LETTERS:
            at += 1
        start = at
        dot = next((d for d in DOTS if text[max(0, at - len(d)) : at].lower() == d), "")
        if not dot:
            break
        at -= len(dot)
    return start if start < end - (text[end - 1 : end] == " ") else end


def email_at(text: str, start: int) -> tuple[int, int] | None:
    """The address around an at-sign."""
    sign = AT_HERE.match(text, start)
    left = local_start(text, start)
    right = DOMAIN.match(text, sign.end()) if sign else None
    return (left, right.end()) if left < start and right else None


def numbers_at(run: str, base: int) -> Iterator[tuple[int, int, str]]:
    """Identity and telephone numbers in a stretch of digits and separators; other numbers are passed over."""
    at = 0
    while at < len(run):
        if at and (run[at - 1].isdigit() and run[at].isdigit()):
            at += 1
            continue
        id_ = IDENTITY.match(run, at)
        if id_ and not run[id_.end() : id_.end() + 1].isdigit():
            digits = re.sub(r"[ -]", "", id_[0])
            if real_date(digits[6:14]):
                yield base + at, base + id_.end(), "id_number"
                at = id_.end()
                continue
        phone = MOBILE.match(run, at) or FIXED.match(run, at)
        if phone and not run[phone.end() : phone.end() + 1].isdigit() and not re.match(r"[ .-]?[0-9]", run[phone.end() : phone.end() + 2]):
            yield base + at, base + phone.end(), "phone"
            at = phone.end()
            continue
        if phone and re.match(r" [0-9+(]", run[phone.end() : phone.end() + 2]):
            yield base + at, base + phone.end(), "phone"
            at = phone.end()
            continue
        whole = re.compile(r"[0-9]+(?:[-.][0-9]+)*").match(run, at)
        at = whole.end() if whole else at + 1


def address_at(text: str, mark: int) -> tuple[int, int] | None:
    """The address whose house number ends at the mark."""
    low = mark
    while low and text[low - 1] in HOUSE_LETTERS:
        low -= 1
    for house in HOUSE.finditer(text, low):
        if house.start() > mark:
            break
        if not house.start() < mark < house.end():
            continue
        front = BEFORE_HOUSE.search(text, max(0, house.start() - 40), house.start())
        if front is None:
            return None
        start = front.start(1)
        lead = LEADING.match(front[1])
        if lead and lead.end() < len(front[1]) - 1:
            start += lead.end()
        return start, house.end()
    return None


CUES = "|".join(sorted((w for w in BEFORE if len(w) > 1), key=len, reverse=True))
SHORT_CUES = "".join(w for w in BEFORE if len(w) == 1)
BEFORE_RE = re.compile(rf"(?:(?:{CUES})[：:“「《（(\s]?|(?:\A|[，。；：\s！？])[{SHORT_CUES}]|案例由)\Z")
BEHIND_RE = re.compile("|".join(sorted(BEHIND, key=len, reverse=True)) + r"|[，。；：、》”」）)（(\s！？,.;:|/]|\Z")
EDGE = re.compile(r"(?:\A|[，。；：、“「《（(\s！？,.;:|/）)%”0-9])\Z")
TITLE_RE = re.compile("|".join(TITLES))


def person_at(text: str, start: int, surname: int, last: tuple[int, int] | None, numbered: set[int]) -> tuple[int, int] | None:
    """The full name that begins with the surname at ``start``; ``last`` is the name before, ``numbered`` ends of numbers and addresses."""
    head = text[max(0, start - 8) : start]
    told = bool(BEFORE_RE.search(head)) or (last is not None and text[last[1] : start] in ("、", "与", "和", "及", "，", "/", " / "))
    edge = told or bool(EDGE.search(head)) or start in numbered
    if not edge or TITLE_RE.match(text, start + surname):
        return None
    for given in (2, 1):
        end = start + surname + given
        name = text[start + surname : end]
        if len(name) < given or any(c in NOT_GIVEN or not "一" <= c <= "鿿" for c in name):
            continue
        sure = SURE_BEHIND.match(text, end)
        near_number = start in numbered or start - 1 in numbered and text[start - 1] in " ，、\n（("
        signed = given == 2 and told and head[-1:] in ("：", ":")
        if sure or signed or (told or near_number) and BEHIND_RE.match(text, end):
            return start, end
    return None


def english_address_at(text: str, end: int) -> tuple[int, int] | None:
    """The address whose kind of street begins behind the space at ``end``: a number and up to three capitalised words before it."""
    high = end
    for _ in range(4):
        low = high
        while low and text[low - 1].isalnum():
            low -= 1
        if found := ENGLISH_ADDRESS.match(text, low):
            return (low, found.end()) if found.end() > end else None
        if low == high or text[low - 1 : low] != " ":
            return None
        high = low - 1
    return None


def english_name_at(text: str, space: int) -> tuple[int, int, int] | None:
    """Start and end of the name whose first and second word the space parts, and the end of the run of capitalised words."""
    low = space
    while low and (text[low - 1].isalpha() and text[low - 1].isascii() or text[low - 1] == "-"):
        low -= 1
    run = ENGLISH_NAME.match(text, low)
    if run is None:
        return None
    words, at = run[0].split(" "), low
    while words and words[0] in NOT_NAMES:
        if words[0] in ("Mr", "Mrs", "Ms", "Dr", "Prof", "Professor", "Miss"):
            words = []
            break
        at += len(words.pop(0)) + 1
    named = len(words) > 1 and not any(w in NOT_NAMES for w in words) and not re.search(r"(?:Mr|Mrs|Ms|Dr|Prof)\. \Z", text[max(0, at - 6) : at])
    return at, at + len(" ".join(words)) if named else at, run.end()


def occurrences(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal information in a text, in reading order and without overlaps."""
    plain = text.translate(WIDE) if re.search(r"[０-９Ａ-Ｚａ-ｚ＠＋．－（）]", text) else text
    hits = [(end - n[1] + 1, n) for end, n in automaton.iter(plain)]
    found: list[tuple[int, int, str]] = []
    done, spelt, english, houses, names = -1, -1, -1, [], []
    for start, (kind, size) in hits:
        if kind == "n":
            names.append((start, size))
        elif kind == "#" and start >= done:
            low = start
            while low > max(0, done) and plain[low - 1] in "+0123456789":
                low -= 1
            low -= low > max(0, done) and plain[low - 1] in "(（"
            run = NUMBER_RUN.match(plain, low)
            if run and run.end() - low >= 8:
                found += numbers_at(run[0].translate({0xFF08: "(", 0xFF09: ")", 0x2014: "-", 0x2013: "-", 0xFF0D: "-"}), low)
            done = max(done, run.end() if run else start + 2)
        elif kind == "@":
            if mail := email_at(plain, start):
                found.append((*mail, "email"))
        elif kind == "h":
            houses.append(start)
        elif kind == "c" and start >= spelt:
            run = SPELT_RUN.match(plain, start)
            if run:
                digits = "".join(SPELT[c] for c in run[0])
                if MOBILE.fullmatch(digits) or FIXED.fullmatch(digits):
                    found.append((start, run.end(), "phone"))
                spelt = run.end()
        elif kind == "s":
            if place := english_address_at(plain, start):
                found.append((*place, "address"))
        elif kind == "e" and start >= english:
            if name := english_name_at(plain, start):
                english = name[2]
                if name[1] > name[0]:
                    found.append((name[0], name[1], "person"))
    for mark in houses:
        if place := address_at(plain, mark):
            found.append((*place, "address"))
    if names:
        ends = {e for _, e, k in found}
        double = {start for start, size in names if size == 2}
        last = None
        for start, size in names:
            if last is not None and start < last[1] or size == 1 and start in double:
                continue
            if person := person_at(plain, start, size, last, ends):
                last = person
                found.append((*person, "person"))
    found.sort(key=lambda f: (f[0], -f[1]))
    out, at = [], 0
    for f in found:
        if f[0] >= at:
            out.append(f)
            at = f[1]
    return out


def find_personal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id>, kind, seq, start, end, found): every occurrence, numbered from 1 per row and kind in reading order."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 1)

    def start():
        automaton = anchors()

        def work(key, text):
            count = dict.fromkeys(KINDS, 0)
            for a, b, kind in occurrences(text, automaton):
                count[kind] += 1
                yield key, kind, count[kind], a, b, text[a:b]

        return work

    kind = rows.schema["id"].dataType.simpleString()
    return map_rows(rows, f"id {kind}, kind string, seq int, start int, end int, found string", start).withColumnRenamed("id", id_col)


def mask_personal(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``df``, with each occurrence in the text replaced by ``[KIND]``."""
    fields = df.schema.names
    place = fields.index(text_col)

    def start():
        automaton = anchors()

        def work(*row):
            text = row[place]
            if text:
                out, at = [], 0
                for a, b, kind in occurrences(text, automaton):
                    out += text[at:a], f"[{kind.upper()}]"
                    at = b
                text = "".join(out) + text[at:]
            yield *row[:place], text, *row[place + 1 :]

        return work

    return map_rows(df, df.schema, start)

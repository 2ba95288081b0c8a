"""Problem 3: same or near-same records in the training and the evaluation split.

Strings are compared by class: rows with the same compared string are one class with its smallest identifier as representative,
so copies cost one comparison. Equal classes of both splits are linked by their digest. The others go through an edit-distance segment
join in blocks: the answers of the evaluation classes are cut into segments, of which ``k + 1`` take part, and the substrings of the training
answers are matched against them at the places that ``k`` edits allow (:mod:`.segments`). The evaluation set is worked off in blocks of
bounded size against all training classes. A pair that is left is tested by the counts of its characters and the places of its grams, neither
of which can lose a pair, and verified by banded dynamic programming: edit distance at most ``most_edits`` of the longer string,
where the band is that bound. Answers are cut and not whole strings because answers must be within the bound by themselves.

A sentence of the passage that stands elsewhere does not differ, but costs its length twice in an edit distance. So a pair above the
bound is measured again without the sentences that both passages have; answers are never reordered and must be within the bound
by themselves.

:func:`overlap_classes` returns the classes and the links between them, :func:`overlap_pairs` the
pairs of samples, :func:`overlap_report` the counts per split and source.

Defined results: samples without messages, without a passage or without an answer have nothing to compare and no links. Several user
messages are one; of several answers the last counts. A user message of one line is all passage. Marks, spacing,
width and case do not count. Repeated rows are members of one class. An empty table gives no links.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .batches import map_rows, map_stream
from .segments import SegmentIndex, codes_of, hashed

MOST_EDITS = 0.2
#: 64-bit words of the signature of a string's characters.
SIGNATURE_WORDS = 16
#: Strings of a block of evaluation classes, of a pack of training classes, and the characters that close either sooner.
BLOCK, PACK, MOST_CHARS = 4096, 4096, 1 << 22
MARKS = re.compile(r"[\W_]+")
ENDS = re.compile(r"[。！？!?；;\n]|\.(?=\s|\Z)")
#: Lines of a user message that name persons, and the lines that frame the passage.
PERSONS = re.compile(
    r"^\s*(?:[【\[]?(?:课题|项目)?(?:负责人|主持人|主持)(?:[（(]签名[)）]|[】\]]|\s*[:：]|\s+)|本(?:课题|项目)由.{2,40}主持|(?:Heads? of project|Project leads?|Led by)\b|(?:鉴定组|课题组成员|指导专家|参与教师|成员|顾问|评审专家)\s*[:：])",
    re.I,
)
FRAMES = re.compile(r"^\s*(?:-{3,}|={3,}|[【\[](?:原文|材料|正文|报告)[】\]]|(?:以下为节选|材料如下|原文如下|Excerpt|Text)\s*[:：]?|现在作答。?|请直接给出结果。?|请开始输出。?|请作答。?)\s*$", re.I)


def passage(message: str) -> str:
    """The source passage of a user message: without the instruction, frames and lines on persons. A single line is all passage."""
    lines = message.strip().split("\n")
    return "\n".join(x for x in lines[len(lines) > 1 :] if not PERSONS.match(x) and not FRAMES.match(x))


def compared(user: str | None, answer: str | None) -> tuple[str, str]:
    plain = lambda s: unicodedata.normalize("NFKC", MARKS.sub("", s or "")).lower()
    return plain(passage(user or "")), plain(answer)


def sentences(user: str | None) -> list[str]:
    """The passage's sentences as they are compared."""
    parts = (unicodedata.normalize("NFKC", MARKS.sub("", x)).lower() for x in ENDS.split(passage(user or "")))
    return [x for x in parts if x]


def leftover(one: list[str], two: list[str]) -> tuple[str, str]:
    """Both passages without the sentences that they share, one for one."""
    common = Counter(one) & Counter(two)

    def rest(parts: list[str]) -> str:
        left, out = common.copy(), []
        for x in parts:
            if left[x]:
                left[x] -= 1
            else:
                out.append(x)
        return "".join(out)

    return rest(one), rest(two)


def banded_distance(a: str, b: str, bound: int) -> int | None:
    """Edit distance, or None where it is above the bound.

    Only the band of ``bound`` diagonals to each side of the main one is held, since no alignment within the bound leaves it: the
    vertical differences of a column are two integers of ``2 * bound + 1`` bits, of which bit ``t`` is row ``j - bound + t`` of column
    ``j``, and a step computes a column by the bit-parallel recurrence of Myers and Hyyrö and moves the band down by one row. What lies below the
    band counts as one more per row, which is never too little. The distance is followed along the band's last diagonal down to the
    last row, and then along that row.
    """
    if abs(len(a) - len(b)) > bound:
        return None
    start, most = 0, min(len(a), len(b))
    while start < most and a[start] == b[start]:
        start += 1
    end = 0
    while end < most - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return max(len(a), len(b))
    rows, columns = len(a), len(b)
    bound = min(bound, max(rows, columns))
    where: dict[str, int] = {}
    for i, char in enumerate(a):
        where[char] = where.get(char, 0) | 1 << i
    band, last = (1 << 2 * bound + 1) - 1, 1 << 2 * bound
    # Column 1: rows above 0 have no difference, the others one each.
    up, down, score = band >> bound << bound, 0, min(bound, rows)
    for j in range(1, columns + 1):
        same, off = where.get(b[j - 1], 0), j - bound - 1
        same = (same >> off if off >= 0 else same << -off) & band
        flat = ((((same & up) + up) ^ up) | same | down) & band
        right, left = down | ~(flat | up) & band, flat & up
        if j + bound <= rows:
            score += not flat & last
        else:
            bit = 1 << rows - j + bound
            score += bool(right & bit) - bool(left & bit)
        if score - (columns - max(j, rows - bound)) > bound:
            return None
        flat >>= 1
        up, down = (left | ~(flat | right)) & band, flat & right
    return score if score <= bound else None


def too_far(a: str, b: str, bound: int) -> bool:
    """A bound from below: characters that one string has more often than the other can't be matched."""
    count = lambda s: np.bincount(np.frombuffer(s.encode("utf-32-le"), dtype="<u4") % 4093, minlength=4093)
    return max(len(a), len(b)) - int(np.minimum(count(a), count(b)).sum()) > bound


def signature(text: str, words: int = SIGNATURE_WORDS) -> np.ndarray:
    """A set of bits, one drawn by each character together with how often it stood before. An edit changes two bits at most."""
    values = hashed(codes_of(text), 1)
    order = np.argsort(values, kind="stable")
    own = values[order]
    places = np.arange(len(own))
    first = np.r_[True, own[1:] != own[:-1]] if len(own) else np.empty(0, bool)
    before = (places - np.maximum.accumulate(np.where(first, places, 0))).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (own + before * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    bits = np.zeros(words * 64, np.uint8)
    bits[(mixed >> np.uint64(32)) % np.uint64(words * 64)] = 1
    return np.packbits(bits).view(np.uint64)


def placed_grams(text: str) -> np.ndarray:
    """Grams of three with their places, as sorted numbers: 31 bits of the hash, then the place."""
    hashes = hashed(codes_of(text), 3)
    return np.sort((hashes >> np.uint64(33)).astype(np.int64) << 32 | np.arange(len(hashes)))


def grams_too_far(one: np.ndarray, two: np.ndarray, bound: int) -> bool:
    """A bound from below: a gram that no edit touches stands in the other text, moved by no more than the bound."""

    def lost(a: np.ndarray, b: np.ndarray) -> int:
        place = a & 0xFFFFFFFF
        at = np.searchsorted(b, a - np.minimum(place, bound))
        return int((b[np.minimum(at, len(b) - 1)] > a + bound).sum() + (at == len(b)).sum()) if len(b) else len(a)

    return lost(one, two) > 3 * bound or lost(two, one) > 3 * bound


def _texts(samples: DataFrame) -> DataFrame:
    said = lambda role: F.filter("messages", lambda m: m.role == role)
    user = F.array_join(F.transform(F.filter(said("user"), lambda m: m.content.isNotNull()), lambda m: m.content), "\n")
    return samples.select(F.col("sample_id").alias("id"), F.when(F.size(said("user")) > 0, user).alias("user"), F.try_element_at(said("assistant"), F.lit(-1))["content"].alias("answer")).where("user is not null and answer is not null")


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _prepared(samples: DataFrame) -> DataFrame:
    """(id, class, size, reply, bits): digest and length of the compared string, the answer of it and that one's signature.

    Written down once, since all steps need it.
    """

    def start():
        def work(key, user, answer):
            source, reply = compared(user, answer)
            if source and reply:
                yield key, _digest(source + reply), len(source + reply), reply, signature(reply).tobytes()

        return work

    return checkpoint(map_rows(_texts(samples), "id bigint, class binary, size int, reply string, bits binary", start))


def _packed(prepared: DataFrame, most: int) -> DataFrame:
    """(classes, sizes, replies, bits): classes packed into few large rows; copies are left out as far as they meet in one row."""

    def work(rows: Iterable[tuple]) -> Iterator[tuple]:
        held, chars = {}, 0
        for key, size, reply, bits in rows:
            if key not in held:
                held[key] = size, reply, bits
                chars += len(reply)
            if len(held) >= most or chars >= MOST_CHARS:
                yield packed(held)
                held, chars = {}, 0
        if held:
            yield packed(held)

    def packed(held: dict) -> tuple:
        sizes, replies, bits = zip(*held.values())
        return list(held), list(sizes), list(replies), b"".join(bits)

    return map_stream(prepared.select("class", "size", "reply", "bits"), "classes array<binary>, sizes array<int>, replies array<string>, bits binary", work)


class _Block:
    """The evaluation classes of one block."""

    def __init__(self, classes: list[bytes], sizes: list[int], replies: list[str], bits: bytes, most_edits: float):
        self.classes, self.sizes, self.replies, self.most_edits = classes, np.array(sizes), replies, most_edits
        self.index = SegmentIndex(replies, most_edits)
        self.signatures = np.frombuffer(bits, np.uint64).reshape(len(classes), -1)

    def near(self, classes: list[bytes], sizes: list[int], replies: list[str], bits: bytes) -> Iterator[tuple[bytes, bytes]]:
        """(a, b) of all pairs whose answers are within the bound and whose lengths can be."""
        whole, own = np.array(sizes), np.frombuffer(bits, np.uint64).reshape(len(classes), -1)
        long_a, long_b = np.array([len(x) for x in replies]), self.index.sizes
        grams = lru_cache(8192)(placed_grams)
        for i, j in self.index.pairs(replies):
            n, m = whole[i], self.sizes[j]
            ok = np.abs(n - m) <= np.floor(self.most_edits * np.maximum(n, m))
            i, j = i[ok], j[ok]
            n, m = long_a[i], long_b[j]
            bound = np.floor(self.most_edits * np.maximum(n, m)).astype(int)
            ok = np.bitwise_count(own[i] ^ self.signatures[j]).sum(axis=1, dtype=int) <= 2 * bound - np.abs(n - m)
            for x, y, k in zip(i[ok].tolist(), j[ok].tolist(), bound[ok].tolist()):
                one, two = replies[x], self.replies[y]
                if one == two or not grams_too_far(grams(one), grams(two), k) and banded_distance(one, two, k) is not None:
                    yield classes[x], self.classes[y]


def _near_answers(train: DataFrame, valid: DataFrame, most_edits: float) -> DataFrame:
    """(a, b): all pairs of classes whose answers are within the bound and whose lengths can be.

    A task holds one block of the evaluation side at a time and takes the packs of one part of the training side through it. Blocks are
    of answers of like length, so training answers of another length pass by a block untouched.
    """
    blocks = checkpoint(_packed(valid.repartitionByRange(1 + valid.count() // BLOCK, F.length("reply"), "class"), BLOCK))
    blocks = blocks.select(*(F.col(c).alias(f"b_{c}") for c in blocks.columns))

    def work(rows: Iterable[tuple]) -> Iterator[tuple]:
        block = None
        for classes, sizes, replies, bits, b_classes, *others in rows:
            if block is None or block.classes != b_classes:
                block = _Block(b_classes, *others, most_edits)
            yield from block.near(classes, sizes, replies, bits)

    return map_stream(_packed(train, PACK).crossJoin(blocks), "a binary, b binary", work)


def _links(train: DataFrame, valid: DataFrame, most_edits: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified links (a, b, edits) between class representatives, and the members of both sides' classes (id, rep)."""

    pt, pv = _prepared(train), _prepared(valid)
    reps = lambda p, c: p.groupBy("class").agg(F.min("id").alias(c))
    rt, rv = reps(pt, "a"), reps(pv, "b")
    equal = rt.join(rv, "class").select("a", "b")
    near = _near_answers(pt, pv, most_edits).toDF("class", "other").distinct()
    near = near.join(rt, "class").select("a", F.col("other").alias("class")).join(rv, "class").select("a", "b")
    pairs = near.union(equal).distinct()
    left = _texts(train).select(F.col("id").alias("a"), F.col("user").alias("user_a"), F.col("answer").alias("answer_a"))
    right = _texts(valid).select(F.col("id").alias("b"), F.col("user").alias("user_b"), F.col("answer").alias("answer_b"))
    full = pairs.join(right, "b").join(left, "a").select("a", "b", "user_a", "answer_a", "user_b", "answer_b")

    def start():
        plain, parts = lru_cache(2048)(compared), lru_cache(2048)(sentences)

        def edits(user_a, answer_a, user_b, answer_b):
            (sa, ra), (sb, rb) = plain(user_a, answer_a), plain(user_b, answer_b)
            x, y = sa + ra, sb + rb
            if x == y:
                return 0
            bound, own = int(most_edits * max(len(x), len(y))), int(most_edits * max(len(ra), len(rb)))
            if too_far(x, y, bound):
                return None
            reply = banded_distance(ra, rb, own)
            if reply is None:
                return None
            whole = banded_distance(x, y, bound)
            if whole is None:
                moved = banded_distance(*leftover(parts(user_a), parts(user_b)), bound - reply)
                whole = None if moved is None else moved + reply
            return whole

        def work(a, b, *texts):
            found = edits(*texts)
            if found is not None:
                yield a, b, found

        return work

    members = lambda p, r, c: p.select("id", "class").join(r, "class").select("id", F.col(c).alias("rep"))
    return map_rows(full, "a bigint, b bigint, edits int", start), members(pt, rt, "a"), members(pv, rv, "b")


def overlap_pairs(train: DataFrame, valid: DataFrame, most_edits: float = MOST_EDITS) -> DataFrame:
    """(sample_a, sample_b, edits): a training and an evaluation sample with the same passage and answer."""
    links, mt, mv = _links(train, valid, most_edits)
    return (
        links.join(mt.withColumnsRenamed({"id": "sample_a", "rep": "a"}), "a")
        .join(mv.withColumnsRenamed({"id": "sample_b", "rep": "b"}), "b")
        .select("sample_a", "sample_b", "edits")
    )


def overlap_classes(train: DataFrame, valid: DataFrame, most_edits: float = MOST_EDITS) -> DataFrame:
    """(sample_id, split, class_id, n_links): one row per sample with its class and the number of linked classes of the other split."""
    links, mt, mv = _links(train, valid, most_edits)
    count = lambda c: links.groupBy(F.col(c).alias("rep")).agg(F.count(F.lit(1)).alias("n_links"))
    side = lambda m, c, name: m.join(count(c), "rep", "left").select(F.col("id").alias("sample_id"), F.lit(name).alias("split"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return side(mt, "a", "train").union(side(mv, "b", "valid"))


def overlap_report(train: DataFrame, valid: DataFrame, source=None, **how) -> DataFrame:
    """(split, source, n_samples, n_overlapping) per split and source; the default source is the folder of the seed file."""
    source = source if source is not None else F.coalesce(F.regexp_extract(F.col("meta.seed_path"), r"^/?[^/]+/([^/]+)/", 1), F.lit(""))
    found = overlap_classes(train, valid, **how).select("sample_id", "split", (F.col("n_links") > 0).alias("hit"))
    rows = train.select("sample_id", F.lit("train").alias("split"), source.alias("source")).union(valid.select("sample_id", F.lit("valid").alias("split"), source.alias("source")))
    return rows.join(found, ["sample_id", "split"], "left").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_samples"), F.count_if("hit").alias("n_overlapping"))

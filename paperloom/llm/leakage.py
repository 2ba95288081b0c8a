"""Problem 7: evaluation passages inside training text.

The windows of the held-out passages are a hash set that is broadcast; every document slides its own windows over the set. Window
hits are then verified: hits of one passage are joined along the same shift, extended to both sides over small changes, and what
they cover of the passage is its share. Passages with a share of at least ``least_share`` are reported.

Text is compared without marks, white space, width and case. A window has ``window`` characters, or ``latin_window`` where it is
Latin letters throughout, since a few words of a language with spaces say as little as a phrase of characters.

A window is one of tokens, where a token is a character, the unit that a text without spaces has.

Size: passages are a fixed evaluation set, read block by block. Each pass broadcasts at most ``windows_per_pass`` windows (about 100 MB); a larger set is
worked off in as many passes over the documents as it needs, so nothing grows with the corpus or beyond its bound.

Defined results: null, blank and very short passages hold no window and match nothing; a passage shorter than its window is compared
as a whole. Null texts match nothing. Repeated documents are each reported. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_rows

MARKS = re.compile(r"[\W_]+")
LATIN = re.compile(r"[a-z0-9]+\Z")
WINDOW, LATIN_WINDOW, LEAST_SHARE = 12, 30, 0.5
WINDOWS_PER_PASS = 500_000


def steps(most: int) -> tuple[tuple[int, int], ...]:
    """Gaps (in the document, in the passage) that an extension may step over, smallest first."""
    return tuple(sorted(((i, j) for i in range(most + 1) for j in range(most + 1) if i + j), key=lambda s: (max(s), abs(s[0] - s[1]), s)))


#: By script: the gaps, about one word, and the agreement that is needed behind one.
SMALL_CHANGE = {False: (steps(4), 5), True: (steps(12), 10)}


def normal(text: str) -> str:
    """Letters and digits only, one width, one case."""
    return unicodedata.normalize("NFKC", MARKS.sub("", text)).lower()


def traced(text: str) -> tuple[str, list[int]]:
    """The normal form with, for each of its characters, the place in the text it comes from."""
    out, where = [], []
    for i, char in enumerate(text):
        for x in normal(char):
            out.append(x)
            where.append(i)
    return "".join(out), where


def passage_windows(text: str, window: int = WINDOW, latin_window: int = LATIN_WINDOW):
    """(place, window) pairs of a normalised passage."""
    if 4 <= len(text) < (latin_window if LATIN.match(text) else window):
        yield 0, text
    for k in range(len(text) - window + 1):
        part = text[k : k + window]
        if LATIN.match(part):
            part = text[k : k + latin_window]
            if len(part) < latin_window or not LATIN.match(part):
                continue
        yield k, part


def extended(doc: str, item: str, a: int, b: int, size: int) -> tuple[int, int, int, int]:
    """Start and end, in the document and in the passage, of a hit stretched over equal text and small changes."""
    i, j = a + size, b + size
    gaps, k = SMALL_CHANGE[item[b : b + size].isascii()]
    while True:
        while i < len(doc) and j < len(item) and doc[i] == item[j]:
            i += 1
            j += 1
        step = next(((p, q) for p, q in gaps if j + q + k <= len(item) and doc[i + p : i + p + k] == item[j + q : j + q + k]), None)
        if step is None:
            break
        i, j = i + step[0] + k, j + step[1] + k
    while True:
        while a and b and doc[a - 1] == item[b - 1]:
            a -= 1
            b -= 1
        step = next(((p, q) for p, q in gaps if a - p >= k and b - q >= k and doc[a - p - k : a - p] == item[b - q - k : b - q]), None)
        if step is None:
            break
        a, b = a - step[0] - k, b - step[1] - k
    return a, i, b, j


def stretches(doc: str, item: str, hits: list[tuple[int, int, int]]) -> tuple[float, list[tuple[int, int]]]:
    """Share of a passage that a document holds, and the document's stretches; hits are (place in doc, place in item, size)."""
    found, cover = [], bytearray(len(item))
    for a, b, size in sorted(hits, key=lambda h: (h[1] - h[0], h[0])):
        if any(s <= a and a + size <= e and abs((a - s) - (b - t)) <= 16 and t <= b and b + size <= u for s, e, t, u in found):
            continue
        s, e, t, u = extended(doc, item, a, b, size)
        found.append((s, e, t, u))
        cover[t:u] = b"\1" * (u - t)
    return sum(cover) / len(item), sorted({(s, e) for s, e, _, _ in found})


def window_set(passages: list[tuple[object, str]], window: int, latin_window: int) -> dict[str, list[tuple[object, int]]]:
    """Window to the passages, and places in them, that hold it: the hash set that is broadcast."""
    at = defaultdict(list)
    for key, text in passages:
        for k, part in passage_windows(text, window, latin_window):
            at[part].append((key, k))
    return dict(at)


class Windows:
    """Matching documents against the hash set of some passages' windows."""

    def __init__(self, items: dict[object, str], at: dict[str, list[tuple[object, int]]], latin_window: int = LATIN_WINDOW):
        self.items, self.at, self.sizes = items, at, sorted({len(x) for x in at})
        self.long_latin = re.compile(rf"[a-z0-9]{{{latin_window}}}")
        self.latin_window = latin_window

    def __call__(self, doc: str, least: float):
        """(passage, share, stretches) for all passages that the normalised document holds at least a share of."""
        at, hits = self.at, defaultdict(list)
        for size in self.sizes:
            if size == self.latin_window and not self.long_latin.search(doc):
                continue
            for k in [k for k in range(len(doc) - size + 1) if doc[k : k + size] in at]:
                for key, place in at[doc[k : k + size]]:
                    hits[key].append((k, place, size))
        for key, own in hits.items():
            share, parts = stretches(doc, self.items[key], own)
            if share >= least:
                yield key, share, parts


def blocks_of(items: DataFrame, most: int) -> Iterator[list[tuple[object, str]]]:
    """The normalised passages in blocks of at most ``most`` letters (or one longer passage), read one block at a time."""
    block, size = [], 0
    for key, passage in items.select("item_id", "passage").where("passage is not null").orderBy("item_id").toLocalIterator():
        text = normal(passage)
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((key, text))
        size += len(text)
    yield block


def _passes(documents: DataFrame, items: DataFrame, schema: T.StructType | str, work, window: int, latin_window: int, windows_per_pass: int) -> list[DataFrame]:
    """One pass over the documents per block of passages: ``work(windows, *row)`` yields output rows."""
    out = []
    for block in blocks_of(items, windows_per_pass):
        shared = documents.sparkSession.sparkContext.broadcast((dict(block), window_set(block, window, latin_window)))

        def start(shared=shared):
            windows = Windows(*shared.value, latin_window)
            return lambda *row: work(windows, *row)

        out.append(map_rows(documents, schema, start))
    return out


def find_leaks(
    documents: DataFrame, items: DataFrame, least_share: float = LEAST_SHARE, window: int = WINDOW, latin_window: int = LATIN_WINDOW, windows_per_pass: int = WINDOWS_PER_PASS
) -> DataFrame:
    """(item_id, doc_id, share, n_stretches)."""
    docs = documents.select("doc_id", "text").where(F.length("text") >= 4)
    item_type, doc_type = items.schema["item_id"].dataType.simpleString(), documents.schema["doc_id"].dataType.simpleString()

    def report(windows, doc_id, text):
        for key, share, parts in windows(normal(text), least_share):
            yield key, doc_id, round(share, 6), len(parts)

    return reduce(DataFrame.union, _passes(docs, items, f"item_id {item_type}, doc_id {doc_type}, share double, n_stretches int", report, window, latin_window, windows_per_pass))


def leaked_spans(windows: Windows, text: str | None, least: float) -> list[tuple[int, int]]:
    """Start and end, in the text itself, of what it holds of passages."""
    if not text or len(text) < 4 or not any(True for _ in windows(normal(text), least)):
        return []
    doc, where = traced(text)
    return sorted((where[a], where[b - 1] + 1) for _, _, parts in windows(doc, least) for a, b in parts)


def without(text: str | None, spans: Iterable[tuple[int, int]]) -> str | None:
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at : max(at, a)])
        at = max(at, b)
    return "".join(out) + text[at:] if at else text


def decontaminate(
    documents: DataFrame, items: DataFrame, mode: str = "documents", least_share: float = LEAST_SHARE, window: int = WINDOW, latin_window: int = LATIN_WINDOW, windows_per_pass: int = WINDOWS_PER_PASS
) -> DataFrame:
    """The documents without the leaking ones (``documents``) or with the leaked stretches cut out of their text (``spans``).

    Stretches are cut where the documents are read, in one pass and without an exchange, as long as the passages are one block. With more
    blocks each pass yields the stretches of the leaking documents only; they are put together per document and then cut.
    """
    sizes = dict(window=window, latin_window=latin_window, windows_per_pass=windows_per_pass)
    if mode == "documents":
        return documents.join(find_leaks(documents, items, least_share, **sizes).select("doc_id").distinct(), "doc_id", "left_anti")
    if mode != "spans":
        raise ValueError("mode is documents or spans")
    place = documents.columns.index("text")

    def cut(windows, *row):
        yield *row[:place], without(row[place], leaked_spans(windows, row[place], least_share)), *row[place + 1 :]

    def found(windows, doc_id, text):
        if spans := leaked_spans(windows, text, least_share):
            yield doc_id, hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest(), [{"a": a, "b": b} for a, b in spans]

    whole = _passes(documents, items, documents.schema, cut, **sizes)
    if len(whole) == 1:
        return whole[0]
    doc_type = documents.schema["doc_id"].dataType.simpleString()
    parts = reduce(DataFrame.union, _passes(documents.select("doc_id", "text"), items, f"_doc {doc_type}, _digest string, _spans array<struct<a:int,b:int>>", found, **sizes))
    spans = parts.groupBy("_doc", "_digest").agg(F.flatten(F.collect_set("_spans")).alias("_spans"))
    joined = documents.join(spans, (F.col("doc_id") == F.col("_doc")) & (F.md5("text") == F.col("_digest")), "left")

    def start():
        def work(*row):
            spans = row[-1] and [(s["a"], s["b"]) for s in row[-1]]
            yield *row[:place], without(row[place], spans or ()), *row[place + 1 : -1]

        return work

    return map_rows(joined.select(*(documents[c] for c in documents.columns), "_spans"), documents.schema, start)

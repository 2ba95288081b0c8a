"""Problem 1: cutting oversized texts at natural boundaries.

A text above the limit is cut by a hierarchy of separators, coarsest first: sections, paragraphs, sentences, words, single
characters. A level is only entered for a stretch that is still too long after the level above. The resulting atoms are packed
greedily: a piece takes the last ``overlap`` characters of its predecessor and then as many whole atoms as the limit allows.

Defined results: null, blank and short texts give no rows (``keep_small`` returns them as one piece). Lengths count code points.
Without its first ``overlap`` characters from the second piece on, the concatenation of the pieces is the text, byte for byte. Pieces end
at boundaries; they begin exactly ``overlap`` characters before their predecessor's end, wherever that is.
Repeated rows are cut each on its own. Other columns are not touched, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows

#: Where a level may cut: at the end of each match.
LEVELS = (
    re.compile(r"(?:\r\n|\r|\n)[ \t　]*(?:\r\n|\r|\n)\s*|(?:\r\n|\r|\n)(?=【|#|第[一二三四五六七八九十百\d]{1,4}[章节部]|[一二三四五六七八九十]{1,3}、)"),
    re.compile(r"\r\n|\r|\n|\u2028|\u2029"),
    re.compile(r"[。！？!?；;…]+[”’」』）)】》\"']*|\.[”’\"')]*(?=\s)"),
    re.compile(r"[，、,：:]+|\s+|[—～]+"),
)
#: Characters that a cut may not come before: combining marks, joiners, variation selectors, the second half of a line end.
TIED = re.compile(r"[\u0300-\u036f\u200d\ufe00-\ufe0f\U000e0100-\U000e01ef\U0001f3fb-\U0001f3ff\n]")


def atoms(text: str, start: int, end: int, cap: int, level: int = 0) -> list[int]:
    """Ends of consecutive stretches of at most ``cap`` characters that cover ``text[start:end]``."""
    if end - start <= cap:
        return [end]
    if level == len(LEVELS):
        out, at = [], start
        while end - at > cap:
            cut = at + cap
            while cut > at + 1 and cut > at + cap - 8 and (TIED.match(text[cut]) or text[cut - 1] == "\u200d"):
                cut -= 1
            out.append(cut)
            at = cut
        return [*out, end]
    cuts = [m.end() for m in LEVELS[level].finditer(text, start, end)]
    out, at = [], start
    for cut in [*cuts, end]:
        if cut > at:
            out += atoms(text, at, cut, cap, level + 1)
            at = cut
    return out


def spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each piece."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    if len(text) <= limit:
        return [(0, len(text))]
    ends = atoms(text, 0, len(text), limit - overlap)
    out, start, i = [], 0, 0
    while i < len(ends):
        last = max(i, bisect_right(ends, start + limit) - 1)
        out.append((start, ends[last]))
        start, i = ends[last] - overlap, last + 1
    return out


def split_oversized(df: DataFrame, id_col: str, text_col: str, limits: DataFrame, keep_small: bool = False) -> DataFrame:
    """(limit_name, <id>, piece, n_pieces, start, end, text) for every text and every limit that it exceeds.

    ``limits`` (limit_name, max_chars, overlap_chars) is a table of parameters: a handful of rows, read once on the driver.
    A limit without a size is ignored; a null overlap is 0.
    """
    rules = sorted((r[0], r[1], r[2] or 0) for r in limits.select("limit_name", "max_chars", "overlap_chars").collect() if r[1] is not None)
    low = -1 if keep_small else min((r[1] for r in rules), default=1 << 30)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > low)

    def start():
        def work(key, text):
            for name, limit, overlap in rules:
                if keep_small or len(text) > limit:
                    cut = spans(text, limit, overlap)
                    for k, (a, b) in enumerate(cut, 1):
                        yield name, key, k, len(cut), a, b, text[a:b]

        return work

    kind = source.schema["id"].dataType.simpleString()
    return map_rows(source, f"limit_name string, id {kind}, piece int, n_pieces int, start int, end int, text string", start).withColumnRenamed("id", id_col)


def rebuilt(pieces: DataFrame, id_col: str, limits: DataFrame) -> DataFrame:
    """(limit_name, <id>, digest, n_wrong): the text's digest put together from its pieces, and how many of these are longer than the
    limit, don't begin with the last ``overlap`` characters of their predecessor, or leave a gap. A check of :func:`split_oversized`."""
    rules = limits.select("limit_name", "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap"))
    ordered = F.array_sort(F.collect_list(F.struct("piece", "start", "end", "text")))
    one = pieces.join(F.broadcast(rules), "limit_name").groupBy("limit_name", id_col).agg(ordered.alias("p"), F.first("max_chars").alias("most"), F.first("overlap").alias("overlap"))
    shared = lambda x, i: F.substring(x["text"], F.lit(1), F.col("overlap")) == F.right(F.get("p", i - 1)["text"], F.col("overlap"))
    fine = lambda x, i: (F.length(x["text"]) <= F.col("most")) & (x["piece"] == i + 1) & (F.length(x["text"]) == x["end"] - x["start"]) & ((i == 0) | (shared(x, i) & (x["start"] == F.get("p", i - 1)["end"] - F.col("overlap"))))
    text = F.array_join(F.transform("p", lambda x, i: F.when(i == 0, x["text"]).otherwise(F.substring(x["text"], F.col("overlap") + 1, F.length(x["text"])))), "")
    return one.select("limit_name", id_col, F.md5(text).alias("digest"), F.size(F.filter("p", lambda x, i: ~fine(x, i))).cast("bigint").alias("n_wrong"))

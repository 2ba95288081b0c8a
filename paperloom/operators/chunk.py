"""Cutting texts into overlapping chunks and removing repeated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import LIMITS
from ..functions.binding import let
from ..functions.text import strip, text


#: The stand-in tokenizer: one ideograph, one run of other letters and digits, or one mark each.
IDEOGRAPHS = r"\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}"
RUN = rf"[\p{{L}}\p{{N}}_&&[^{IDEOGRAPHS}]]+"
TOKEN = rf"[{IDEOGRAPHS}]|{RUN}|[^\p{{L}}\p{{N}}_\p{{Z}}\s]"


def word_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(text(c), F.lit(TOKEN), F.lit(0))


def count_tokens(c: Column | str) -> Column:
    """How many tokens :func:`word_tokens` gives, without making them: what is left when runs are one letter and white space is gone."""
    return F.length(F.regexp_replace(F.regexp_replace(text(c), RUN, "w"), r"[\p{Z}\s]+", ""))


def has_tokens(c: Column | str) -> Column:
    """Whether there is a token. A filter on the tokens themselves would be pushed below them and make them twice."""
    return text(c).rlike(r"[^\p{Z}\s]")


def token_chunks(tokens: Column, size: int = LIMITS.chunk_tokens, overlap: int = LIMITS.token_overlap) -> Column:
    """array<array<token>>: windows of ``size`` that start every ``size - overlap`` tokens; none for no tokens."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and less than the size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size(tokens) - size) / step).cast("int"))
    return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i * step + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def split_paragraphs(c: Column | str) -> Column:
    """Pieces between blank lines where there are any, else lines, else the whole; stripped, without blank ones."""
    cut = lambda body: F.when(F.contains(body, F.lit("\n\n")), F.split(body, "\n\n")).when(F.contains(body, F.lit("\n")), F.split(body, "\n")).otherwise(F.array(body))
    return F.filter(F.transform(let(text(c), cut), strip), lambda x: x != "")


def pack_paragraphs(paras: Column, size: int = LIMITS.chunk_chars, overlap: int = LIMITS.chunk_overlap) -> Column:
    """array<string>: paragraphs packed greedily up to ``size`` characters.

    A paragraph counts two characters more than its length. One that is too long by itself closes the chunk at hand and is cut hard,
    without overlap, and the next paragraph starts empty. Otherwise a new chunk begins with the last ``overlap``
    characters of the one before.
    """
    closed = lambda s: F.when(s["buf"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(strip(s["buf"]))))
    state = lambda done, buf, n: F.struct(done.alias("done"), buf.cast("string").alias("buf"), n.cast("int").alias("n"))

    def cut(done: Column, p: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.length(p) / size).cast("int") - 1), lambda i: strip(F.substring(p, i * size + 1, F.lit(size))))
        return state(F.concat(done, pieces), F.lit(None), F.lit(0))

    def opened(done: Column, p: Column) -> Column:
        tail = F.coalesce(strip(F.right(F.try_element_at(done, F.lit(-1)), F.lit(overlap))), F.lit("")) if overlap else F.lit("")
        return let(tail, lambda t: state(done, F.when(t != "", F.concat(t, F.lit("\n\n"), p)).otherwise(p), F.when(t != "", F.length(t) + F.length(p) + 2).otherwise(F.length(p))))

    def step(s: Column, p: Column) -> Column:
        long = F.length(p)
        added = state(s["done"], F.when(s["buf"].isNull(), p).otherwise(F.concat(s["buf"], F.lit("\n\n"), p)), s["n"] + long + 2)
        return F.when((long <= size) & (s["n"] + long + 2 <= size), added).otherwise(let(closed(s), lambda done: F.when(long > size, cut(done, p)).otherwise(opened(done, p))))

    none = state(F.array().cast("array<string>"), F.lit(None), F.lit(0))
    return F.aggregate(paras, none, step, closed)


def unique_prefixes(chunks: Column, prefix: int = LIMITS.dedup_prefix) -> Column:
    """The first chunk of each prefix, in order."""
    heads = lambda all_: F.transform(all_, lambda c: F.substring(c, 1, prefix))
    return let(chunks, lambda all_: let(heads(all_), lambda h: F.filter(all_, lambda c, i: F.array_position(h, F.substring(c, 1, prefix)) == i + 1)))


def paragraph_chunks(c: Column | str, size: int = LIMITS.chunk_chars, overlap: int = LIMITS.chunk_overlap) -> Column:
    return unique_prefixes(pack_paragraphs(split_paragraphs(c), size, overlap))


def keep_first(df: DataFrame, key: Column, order: list[str], within: list[str] | None = None) -> DataFrame:
    """One row per key (and group), the first by order.

    A minimum over the row, not a sort of the group: it is combined before the shuffle, so a key that a third of all rows share
    costs one row per task.
    """
    picked = df.groupBy(*(within or []), key.alias("_key")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


def chunk_table(df: DataFrame, id_col: str, text_col: str, size: int = LIMITS.chunk_chars, overlap: int = LIMITS.chunk_overlap) -> DataFrame:
    """(<id>, chunk_idx, text)."""
    return df.select(id_col, F.posexplode(paragraph_chunks(text_col, size, overlap)).alias("chunk_idx", "text"))


def token_chunk_table(df: DataFrame, id_col: str, text_col: str, size: int = LIMITS.chunk_tokens, overlap: int = LIMITS.token_overlap) -> DataFrame:
    """(<id>, chunk_idx, tokens, text); tokens are joined by spaces, as a stand-in for a tokenizer's own decoding."""
    tokens = df.where(has_tokens(text_col)).select(id_col, word_tokens(text_col).alias("tokens"))
    rows = tokens.select(id_col, F.posexplode(token_chunks(F.col("tokens"), size, overlap)).alias("chunk_idx", "tokens"))
    return rows.withColumn("text", F.array_join("tokens", " "))


def running(value: str, within: list[str], order: list[str]) -> Column:
    return F.sum(value).over(Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))

"""Scalar text functions as column expressions. Null counts as the empty string; lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LIMITS, TITLES
from .binding import let

#: White space in the sense of Unicode, which the engine's own ``\\s`` and ``trim`` only cover in part.
WS = r"[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def has_text(c: Column | str) -> Column:
    """Whether anything but white space is there."""
    return text(c).rlike(WS.replace("[", "[^", 1))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def normalize_text(c: Column | str) -> Column:
    """Wide spaces and tabs to spaces, runs of spaces to one, three or more line ends to two, ends stripped."""
    spaced = F.regexp_replace(F.translate(text(c), "　\t", "  "), " {2,}", " ")
    return strip(F.regexp_replace(spaced, "\n{3,}", "\n\n"))


def safe_filename(c: Column | str, most: int | None = None, repl: str = "_") -> Column:
    """Characters that file systems refuse become ``repl``; trailing dots and spaces go; ``most`` cuts last."""
    clean = strip(F.regexp_replace(F.regexp_replace(normalize_text(c), r'[\\/:*?"<>|]', repl), rf"{WS}+", " "))
    name = F.regexp_replace(clean, r"[ .]+\z", "")
    return F.substring(name, 1, most) if most else name


def loose_key(c: Column | str) -> Column:
    """Letters, digits and underscores only, lower case."""
    return F.lower(F.regexp_replace(normalize_text(c), r"[^\p{L}\p{N}_]+", ""))


def strip_title_prefix(c: Column | str, title: str) -> Column:
    return F.regexp_replace(normalize_text(c), rf"^{WS}*\Q{title}\E{WS}*[:：]?{WS}*", "")


def visible_length(c: Column | str) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(text(c), rf"{WS}+", ""))


def guided_query(title: Column | str, hint: Column | str) -> Column:
    """The title, with the hint on a second line where there is one, cut to the query limit."""
    joined = F.concat_ws("\n", text(title), F.nullif(text(hint), F.lit("")))
    return F.substring(normalize_text(joined), 1, LIMITS.query_chars)


def evidence_block(title: Column, c: Column, normal: bool = False) -> Column:
    """A block under its section's header; null where there is no text. A text that is normalised already is ``normal``."""
    return let(c if normal else normalize_text(c), lambda body: F.when(body != "", F.concat(F.lit("【"), title, F.lit("证据】\n"), body)))


def merge_sections(parts: dict[str, Column], titles: tuple[str, ...] = TITLES) -> Column:
    lines = [F.concat(F.lit(f"{t}："), normalize_text(parts.get(t, F.lit("")))) for t in titles]
    return normalize_text(F.concat_ws("\n", *lines))


def cache_key(doc_id: Column, chunks: Column, model: str, chunk: int = LIMITS.chunk_tokens, overlap: int = LIMITS.token_overlap) -> Column:
    """Key of a document's cached embeddings: identifier, digest of all its chunks, model and chunking."""
    return F.md5(F.concat_ws("||", text(doc_id), F.md5(F.array_join(chunks, "")), F.lit(model), F.lit(str(chunk)), F.lit(str(overlap))))

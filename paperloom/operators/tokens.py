"""Tokenizers as providers, token ids of texts and of chunks, chat templates, batches for a trainer."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions.text import text
from .chunk import token_chunks

#: Fixed value: the pattern that byte-pair vocabularies of this kind are defined over.
BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


def bpe(path: str, pattern: str = BPE_PATTERN) -> Callable[[], Tokenizer]:
    """A provider from a public byte-pair vocabulary. The file is read here, once, and travels with the job; workers need no copy of it."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}

    def load() -> Tokenizer:
        import tiktoken

        encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        class Loaded:
            def encode(self, text: str) -> list[int]:
                return encoding.encode_ordinary(text)

            def decode(self, ids: list[int]) -> str:
                return encoding.decode(ids)

        return Loaded()

    return load


def encode_ids(provider: Callable[[], Tokenizer]) -> Callable[[Column], Column]:
    """A column function from texts to array<int>; null counts as the empty text. The provider runs once per task."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = provider()
        for texts in batches:
            yield texts.map(lambda t: tokenizer.encode(t or ""))

    return encode


def decode_ids(provider: Callable[[], Tokenizer]) -> Callable[[Column], Column]:
    """A column function from array<int> to texts."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = provider()
        for lists in batches:
            yield lists.map(lambda ids: None if ids is None else tokenizer.decode(list(ids)))

    return decode


def chunk_texts(provider: Callable[[], Tokenizer], size: int = LIMITS.chunk_tokens, overlap: int = LIMITS.token_overlap) -> Callable[[Column], Column]:
    """A column function from texts to array<string>: windows over the tokenizer's ids, decoded by it; none for no tokens."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and less than the size")

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = provider()

        def windows(body: str | None) -> list[str]:
            ids = tokenizer.encode(body or "")
            last = max(0, -(-(len(ids) - size) // (size - overlap)))
            return [tokenizer.decode(ids[i * (size - overlap) : i * (size - overlap) + size]) for i in range(last + 1)] if ids else []

        for texts in batches:
            yield texts.map(windows)

    return cut


def joined_chunks(tokens: Column, size: int = LIMITS.chunk_tokens, overlap: int = LIMITS.token_overlap) -> Column:
    """array<string>: windows of the stand-in's tokens, joined by spaces."""
    return F.transform(token_chunks(tokens, size, overlap), lambda w: F.array_join(w, " "))


def chat_text(messages: Column, answer_next: bool = False) -> Column:
    """Messages under the ChatML template; ``answer_next`` opens the assistant's turn."""
    turn = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), text(m["content"]), F.lit("<|im_end|>\n"))
    return F.concat(F.array_join(F.transform(messages, turn), ""), F.lit("<|im_start|>assistant\n" if answer_next else ""))


def batches(encoded: DataFrame, size: int) -> DataFrame:
    """(input_ids, attention_mask, labels), each array<array<int>> of ``size`` samples (the last of a task may have fewer), from columns of
    array<int>: the rows that a trainer's loader takes as tensors."""
    names = ("input_ids", "attention_mask", "labels")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([list(c)], pa.list_(pa.list_(pa.int32()))) for c in zip(*rows)], names=list(names))

        for part in parts:
            for row in zip(*(c.to_pylist() for c in part.columns)):
                held.append(row)
                if len(held) == size:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    return encoded.select(*names).mapInArrow(run, ", ".join(f"{n} array<array<int>>" for n in names))

"""Whole-corpus encoding with a public byte-level BPE, from a local rank file.

Texts are encoded in Arrow batches; each worker process loads the rank file once. A long text is first cut at places where
the pre-tokenising pattern always ends a piece, so that the ids are the same as of the uncut text while no single call
grows with the longest text of the corpus. Ids decode through raw bytes: an id may end within a character.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from weftline.runtime import spread

#: Folder of the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"

#: Fixed value: the published pre-tokenising pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts beyond this many characters are cut at safe boundaries.
LONG = 50_000


def load(path: str):
    """The encoding of a rank file, once per worker process."""
    import tiktoken
    import tiktoken.registry as registry

    name = f"ranks:{path}"
    if name not in registry.ENCODINGS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        registry.ENCODINGS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return registry.ENCODINGS[name]


def safe_pieces(text: str, long: int = LONG) -> Iterator[str]:
    """Parts of ``text`` that encode independently.

    A cut is made only before a blank between two letters, or else between a letter and a digit: in either place one
    pre-token ends and the next begins whatever stands around, since no alternative of the pattern spans it and none looks
    behind. Where a stretch has no such place, the part is longer.
    """
    import regex

    if len(text) <= long:
        yield text
        return
    boundary = regex.compile(r"(?<=\p{L}) (?=\p{L})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=\p{N}) (?=[\p{L}\p{N}])")
    start = 0
    while len(text) - start > long:
        cut = boundary.search(text, start + long)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(encoding, text: str | None, long: int = LONG) -> list[int]:
    """Ids of a text, every string in it read as ordinary text; none for null and empty."""
    if not text:
        return []
    if len(text) <= long:
        return encoding.encode_ordinary(text)
    return [i for piece in safe_pieces(text, long) for i in encoding.encode_ordinary(piece)]


def encode_column(df: DataFrame, text: str = "text", ids: str = "ids", path: str = f"{TOKENIZERS}/{RANKS}", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``ids`` (array<int>) of every row; null and empty texts give an empty array. Repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(path)
        for batch in batches:
            out = pa.array([encode(encoding, t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*keep, ids])

    source = spread(df.select(*keep, F.col(text).alias("__text")))
    schema = source.drop("__text").schema.add(ids, T.ArrayType(T.IntegerType()))
    return source.mapInArrow(run, schema)


def count_column(df: DataFrame, text: str, count: str, path: str = f"{TOKENIZERS}/{RANKS}", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the number of tokens (bigint), without moving the ids out of the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(path)
        for batch in batches:
            out = pa.array([len(encode(encoding, t)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*keep, count])

    source = spread(df.select(*keep, F.col(text).alias("__text")))
    return source.mapInArrow(run, source.drop("__text").schema.add(count, T.LongType()))


def decode_column(ids: str | Column, path: str = f"{TOKENIZERS}/{RANKS}") -> Column:
    """Raw bytes of an array of ids; null ids give null. Bytes, not text: a slice of ids may cut a character."""
    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        encoding = load(path)
        return rows.map(lambda row: None if row is None else encoding.decode_bytes(list(map(int, row))))

    return run(F.col(ids) if isinstance(ids, str) else ids)

"""Byte-level BPE encoding of whole texts with a public vocabulary.

A text is split by the vocabulary's pattern; each distinct part is merged once
per Python worker by a contiguous rank array: the part's boundaries and the
ranks of adjacent pairs lie in two flat lists, the least rank is found by a
scan, its boundary is deleted and the two neighbouring ranks are looked up
again. Long unbroken parts, for which scanning would be quadratic, are merged
through a heap with the same order of merges.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fixed value: the split pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
FILE = "byte_bpe_50k.tiktoken"
#: Parts of more bytes than this are merged through a heap.
SCAN_BYTES = 192
#: Distinct parts kept per Python worker; beyond it the memory is emptied.
MEMORY_PARTS = 400_000

_NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 tokens and ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_scan(part: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one part by the contiguous rank array."""
    whole = ranks.get(part)
    if whole is not None:
        return (whole,)
    get = ranks.get
    edge = list(range(len(part) + 1))
    rank = [get(part[k : k + 2], _NEVER) for k in range(len(part) - 1)]
    while rank:
        least = min(rank)
        if least == _NEVER:
            break
        k = rank.index(least)
        del edge[k + 1]
        del rank[k]
        if k < len(rank):
            rank[k] = get(part[edge[k] : edge[k + 2]], _NEVER)
        if k:
            rank[k - 1] = get(part[edge[k - 1] : edge[k + 1]], _NEVER)
    return tuple(ranks[part[a:b]] for a, b in itertools.pairwise(edge))


def merge_heap(part: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same merges for a long part in n log n steps."""
    n = len(part)
    end = list(range(1, n + 1))  # end of the piece that begins here
    before = list(range(-1, n - 1))
    alive = bytearray(b"\x01") * n
    heap = []

    def offer(a: int) -> None:
        b = end[a]
        if b < n:
            r = ranks.get(part[a : end[b]])
            if r is not None:
                heapq.heappush(heap, (r, a, b, end[b]))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, b, stop = heapq.heappop(heap)
        if not alive[a] or end[a] != b or not alive[b] or end[b] != stop:
            continue
        alive[b] = 0
        end[a] = stop
        if stop < n:
            before[stop] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, a = [], 0
    while a < n:
        out.append(ranks[part[a : end[a]]])
        a = end[a]
    return tuple(out)


class _Parts(dict):
    """Ids of parts met before; others are merged on first sight."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, part: str) -> tuple[int, ...]:
        raw = part.encode("utf-8", "replace")
        ids = merge_scan(raw, self.ranks) if len(raw) <= SCAN_BYTES else merge_heap(raw, self.ranks)
        if len(part) <= 64:
            self[part] = ids
        return ids


_READY: dict[str, tuple] = {}


def _tools(path: str) -> tuple:
    if path not in _READY:
        import regex

        _READY[path] = (regex.compile(PATTERN), _Parts(read_ranks(path)))
    split, parts = _READY[path]
    if len(parts) > MEMORY_PARTS:
        parts.clear()
    return split, parts


def encode(text: str | None, path: str) -> list[int]:
    """Ids of one text; an empty list for null and empty texts."""
    split, parts = _tools(path)
    return list(itertools.chain.from_iterable(map(parts.__getitem__, split.findall(text)))) if text else []


def vocabulary_path(folder: str = VOCABULARY, file: str = FILE) -> str:
    return os.path.join(folder, file)


def encode_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every document, without special tokens.

    Null and empty texts give an empty list; blank texts are encoded as they
    are. Special-token strings in a text are ordinary text. One row per input
    row, repeated rows included. A narrow stage: no shuffle, only the id and
    the text are read.
    """
    where = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            split, parts = _tools(where)
            find, look = split.findall, parts.__getitem__
            lists = [np.fromiter(itertools.chain.from_iterable(map(look, find(t))), np.int32) if t else np.empty(0, np.int32) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            values = np.concatenate(lists) if lists else np.empty(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    out = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.select(F.col("id").alias(id_col), "ids")


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens int): as ``encode_documents``, but only the lengths leave Python."""
    where = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split, parts = _tools(where)
            find, look = split.findall, parts.__getitem__
            sizes = [sum(map(len, map(look, find(t)))) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], ["id", "n_tokens"])

    kind = documents.schema[id_col].dataType.simpleString()
    out = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens int")
    return out.select(F.col("id").alias(id_col), "n_tokens")


def count_series(texts: pd.Series, path: str | None = None) -> pd.Series:
    """Lengths of a series of texts (for tests)."""
    return texts.map(lambda t: len(encode(t, path or vocabulary_path())))

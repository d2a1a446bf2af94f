"""Operator 8, token counts: heap-and-linked-list byte-pair merging over whole texts; no identifiers are made."""

from __future__ import annotations

import functools
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, small_batches, sole_holder, tokenizer_path
from .piece_model import load


def count_word(word: str, rank_of: dict[str, int], single: dict[str, int]) -> int:
    """Initial symbols minus merges, plus the extra bytes of characters that the vocabulary lacks.

    Symbols form a linked list; a heap holds adjacent pairs by (rank, place). An entry is stale if its left symbol is
    gone or the pair no longer has the recorded length; the same place and length are the same characters.
    """
    n = len(word)
    extra = 0
    for c in word:
        if c not in single:
            extra += len(c.encode()) - 1
    if n == 1:
        return 1 + extra
    size = [1] * n
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    get = rank_of.get
    heap = [(r, i, 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapify(heap)
    merges = 0
    while heap:
        _, i, long = heappop(heap)
        j = i + size[i]
        if not size[i] or j >= n or size[i] + size[j] != long:
            continue
        size[j] = 0
        size[i] = long
        merges += 1
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
            if (r := get(word[i : k + size[k]])) is not None:
                heappush(heap, (r, i, long + size[k]))
        h = before[i]
        if h >= 0 and (r := get(word[h : i + long])) is not None:
            heappush(heap, (r, h, size[h] + long))
    return n - merges + extra


@functools.lru_cache(maxsize=4)
def _memo(path: str) -> Memo:
    model = load(path)
    return Memo(lambda w: count_word(w, model.rank_of, model.ids))


def count_text(text: str | None, path: str) -> int:
    return sum(map(_memo(path).__getitem__, load(path).words(text or "")))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) per row of `docs`, in one pass without a shuffle.

    Null texts count as empty: no bytes, no tokens. Repeated rows and null keys each give their own row; other columns
    are not read. An empty table gives an empty result. A word's count is kept in a bounded memo per Python worker.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        sole_holder("piece_count", _memo.cache_clear)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [count_text(t, path) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

"""Operator 4, SentencePiece encoding and decoding by vectorised merge rounds over flat numpy symbol arrays."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, sole_holder, tokenizer_path
from .piece_model import SPACE, PieceModel, load

NONE = np.int64(1 << 40)  # rank of a pair that doesn't merge


class Codec:
    def __init__(self, model: PieceModel, limit: int = 500_000) -> None:
        self.model = model
        self.size = len(model.pieces)
        pairs = {}
        for piece, i in model.ids.items():
            for k in range(1, len(piece)):
                a, b = model.ids.get(piece[:k]), model.ids.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.ranks = np.array([model.rank[i] for i in self.made], np.int64)
        self.raw = [bytes([model.byte_of[i]]) if i in model.byte_of else p.replace(SPACE, " ").encode() if i in model.rank else b"" for i, p in enumerate(model.pieces)]
        self.raw[0] = " ⁇ ".encode()
        self.memo: dict[str, tuple[str, int]] = {}
        self.limit = limit

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair of symbols; symbols past the vocabulary never merge."""
        k = np.where((a < self.size) & (b < self.size), a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        hit = self.keys[at] == k
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.made[at], -1)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. In a round each word merges its lowest-ranked pair, leftmost first.

        Further places of the same pair merge in the same round unless one of the merges makes a pair of lower rank:
        the sequential order would then go on there first, so the round ends behind it.
        """
        text = "".join(words)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        chars, back = np.unique(code, return_inverse=True)
        ids = np.array([self.model.ids.get(chr(c), self.size + int(c)) for c in chars], np.int64)
        sym = ids[back] if len(code) else np.zeros(0, np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        full, made = np.full(len(sym), NONE), np.full(len(sym), -1)
        if len(sym) > 1:
            full[:-1], made[:-1] = self.pair(sym[:-1], sym[1:])
            full[:-1][word[:-1] != word[1:]] = NONE
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(full, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            if (gone := least == NONE).any():  # words that are done leave the arrays
                gone = np.repeat(gone, sizes)
                done.append((word[gone], sym[gone]))
                sym, word, full, made, least, sizes = sym[~gone], word[~gone], full[~gone], made[~gone], least[least < NONE], sizes[least < NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(full == np.repeat(least, sizes))
            # Of places that overlap (aaa), every second one of a run of neighbours counts from the left.
            new = np.r_[True, np.diff(at) > 1]
            start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            m, r, w = made[at], full[at], word[at]
            if len(at) > len(sizes):
                # A pair of lower rank that a merge makes: with the symbol behind, or with what stands before by then.
                behind = np.minimum(at + 2, len(sym) - 1)
                first = self.pair(m, sym[behind])[0]
                first[(at + 2 >= len(sym)) | (word[behind] != w)] = NONE
                left = sym[np.maximum(at - 1, 0)]
                touching = np.r_[False, (at[1:] == at[:-1] + 2) & (w[1:] == w[:-1])]
                left = np.where(touching, np.r_[m[:1], m[:-1]], left)
                second = self.pair(left, m)[0]
                second[(at == 0) | (word[np.maximum(at - 1, 0)] != w)] = NONE
                stops = np.minimum(first, second) < r
                before = np.cumsum(stops) - stops
                begin = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                base = np.repeat(before[begin], np.diff(np.r_[begin, len(w)]))
                at, m = at[before == base], m[before == base]
            sym[at] = m
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            where = at - np.arange(len(at))  # places after compaction
            sym, word, full, made = sym[keep], word[keep], full[keep], made[keep]
            changed = np.r_[where, where - 1]
            changed = changed[changed >= 0]
            on = np.minimum(changed + 1, len(sym) - 1)
            rank, full_made = self.pair(sym[changed], sym[on])
            rank[(on == changed) | (word[on] != word[changed])] = NONE
            full[changed], made[changed] = rank, full_made
        word, sym = (np.concatenate([x[k] for x in done] or [np.zeros(0, np.int64)]) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        word, sym = word[order], sym[order]
        flat = sym.tolist()
        if len(sym) and int(sym.max()) >= self.size:  # characters that the vocabulary lacks become their bytes
            lists: list[list[int]] = [[] for _ in words]
            for w, s in zip(word.tolist(), flat, strict=True):
                lists[w] += [s] if s < self.size else [self.model.byte_ids[b] for b in chr(s - self.size).encode()]
            return lists
        ends = np.searchsorted(word, np.arange(len(words) + 1))
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode_texts(self, texts: list[str]) -> list[tuple[str, int]]:
        """(ids joined by commas, their number) of each text. Words that are not known yet are encoded together."""
        split = [self.model.words(t) for t in texts]
        seen = dict.fromkeys(w for ws in split for w in ws)
        if len(self.memo) + len(seen) > self.limit:
            self.memo.clear()
        todo = [w for w in seen if w not in self.memo]
        for k in range(0, len(todo), 50_000):
            part = todo[k : k + 50_000]
            for w, ids in zip(part, self.encode_words(part), strict=True):
                self.memo[w] = (",".join(map(str, ids)), len(ids))
        out = []
        for ws in split:
            got = [self.memo[w] for w in ws]
            out.append((",".join([g[0] for g in got]), sum([g[1] for g in got])))
        return out

    def encode(self, text: str) -> list[int]:
        ids, n = self.encode_texts([text])[0]
        return list(map(int, ids.split(","))) if n else []

    def decode(self, ids: list[int]) -> str:
        return self.decode_joined(",".join(map(str, ids)))

    def decode_joined(self, ids: str) -> str:
        """Pieces in turn with spaces for space signs; the dummy prefix goes; bytes that are no UTF-8 become U+FFFD."""
        if not ids:
            return ""
        raw = np.fromiter(map(int, ids.split(",")), np.int64)
        out = b"".join([self.raw[i] for i in raw.tolist()])
        return (out[1:] if self.model.pieces[int(raw[0])].startswith(SPACE) else out).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(load(path))


def encoded(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Per row of `docs`: (key, n_tokens, ids array<int>, decoded string), or with `digests` their SHA-256 instead.

    Whole texts, one pass, no shuffle. Null and empty texts have no ids and decode to the empty text. Repeated rows and
    null keys each give their own row; other columns are not read. An empty table gives an empty result.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        sole_holder("piece_codec", codec.cache_clear)
        c = codec(path)
        for b in batches:
            got = c.encode_texts([t or "" for t in b.column(1).to_pylist()])
            n = pa.array([g[1] for g in got], pa.int64())
            if digests:
                more = [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in part], pa.string()) for part in ([g[0] for g in got], [c.decode_joined(g[0]) for g in got])]
                yield pa.RecordBatch.from_arrays([b.column(0), n, *more], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                ids = pa.array([list(map(int, g[0].split(","))) if g[1] else [] for g in got], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), n, ids, pa.array([c.decode_joined(g[0]) for g in got], pa.string())], names=[key, "n_tokens", "ids", "decoded"])

    more = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens long, {more}")

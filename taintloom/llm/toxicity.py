"""Operator 5, toxicity by a classifier chain: categories in turn, each a linear model that is fed the probabilities of
the categories before it. The later models are trained with out-of-fold probabilities, so what they are fed in training
is as uncertain as what they get later.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, in_task, small_batches, sole_holder

WORD = re.compile(r"[^\W\d_]+")
BITS = 22
FOLDS = 5
#: The chain, in its order. `toxic`, the last and the one that decides, is labelled; the two grades before it are weak
#: labels made of it and of out-of-fold evidence.
CATEGORIES = ("toxic_dense", "toxic_repeated", "toxic")


def grams(word: str) -> np.ndarray:
    """Hashed features of a word in lower case: itself and its n-grams of 4 to 6 bytes with both ends marked."""
    w = f"^{word}$".encode()
    found = {b"=" + w, *(w[i : i + k] for k in (4, 5, 6) for i in range(len(w) - k + 1))}
    return np.array([zlib.crc32(g) & ((1 << BITS) - 1) for g in found], np.int32)


@dataclass
class Lexicon:
    """Features that speak for the first category, sorted, and which of them a word has."""

    chosen: np.ndarray

    def hits(self, word_grams: np.ndarray) -> tuple[int, ...]:
        if not len(self.chosen):
            return ()
        at = np.minimum(np.searchsorted(self.chosen, word_grams), len(self.chosen) - 1)
        return tuple(at[self.chosen[at] == word_grams].tolist())


def choose(docs: list[np.ndarray], y: np.ndarray, most: int) -> Lexicon:
    """The `most` best features whose share of positive documents is over 8 times that of negative ones, in so many positive documents that
    of 100,000 features that are dealt over documents by chance less than one would stand in those alone."""
    least = max(3, int(np.ceil(np.log(1e5) / -np.log(np.clip(y.mean(), 1e-9, 0.5)))))
    df = [np.zeros(1 << BITS, np.float32) for _ in range(2)]
    for d, label in zip(docs, y, strict=True):
        df[int(label)][d] += 1
    n = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    score = np.log((df[1] + 0.1) / n[1]) - np.log((df[0] + 0.5) / n[0])
    ok = np.flatnonzero((df[1] >= least) & (score > np.log(8)))
    best = np.argsort(-score[ok] * np.log1p(df[1][ok]), kind="stable")[:most]
    return Lexicon(np.sort(ok[best]).astype(np.int32))


def fit_linear(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, size: int, rounds: int = 150, l2: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression on binary features (indexes per row), dense ones and a bias, by Adagrad."""
    n = len(y)
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    dense = np.c_[extra, np.ones(n)]
    w, v = np.zeros(size), np.zeros(dense.shape[1])
    g_w, g_v = np.full(size, 1e-8), np.full(len(v), 1e-8)
    for _ in range(rounds):
        z = np.bincount(of, w[flat], n) + dense @ v
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        a, b = np.bincount(flat, d[of], size) + l2 * w / n, dense.T @ d
        g_w += a * a
        g_v += b * b
        w -= 0.3 * a / np.sqrt(g_w)
        v -= 0.3 * b / np.sqrt(g_v)
    return np.r_[w, v]


@dataclass
class Chain:
    lexicon: Lexicon
    weights: list[np.ndarray]
    repeats: int

    def probabilities(self, rows: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
        """rows: a text's distinct features; counts: (words with a hit, distinct ones of them, words)."""
        p: list[np.ndarray] = []
        size = len(self.lexicon.chosen)
        flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        for w in self.weights:
            dense = np.c_[_dense(counts), *p, np.ones(len(rows))]
            p.append(1 / (1 + np.exp(-np.clip(np.bincount(of, w[:size][flat], len(rows)) + dense @ w[size:], -30, 30))))
        return np.stack(p, 1) if p else np.zeros((len(rows), 0))


def _dense(counts: np.ndarray) -> np.ndarray:
    hits, distinct, words = counts.T.astype(float)
    return np.c_[np.log1p(hits), np.log1p(distinct), 30 * hits / np.maximum(words, 30)]


def _seen(words: list[str], memo: Memo, repeats: int) -> tuple[np.ndarray, tuple[int, int, int]]:
    """(features, (hits, distinct words with a hit, words)) of a text; a word makes `repeats` hits at most, so that one
    that is repeated throughout a text doesn't decide."""
    found = Counter(w for w in words if memo[w])
    features = np.array(sorted({i for w in found for i in memo[w]}), np.int64)
    return features, (sum(min(n, repeats) for n in found.values()), len(found), len(words))


def _ranges(ends: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The places ends[i] to ends[i + 1] of each i of `which`, one behind the other."""
    sizes = ends[which + 1] - ends[which]
    return np.arange(sizes.sum()) + np.repeat(ends[which] - np.cumsum(sizes) + sizes, sizes)


def train(texts: list[str], toxic: list[int], keys: list[int], most_features: int = 4000, repeats: int = 5) -> Chain | None:
    """The chain of labelled texts; None if a class is missing. Folds are a hash of the key."""
    y = np.array(toxic)
    if len(set(toxic)) < 2:
        return None
    vocabulary: dict[str, int] = {}
    words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(t.lower())], np.int64) for t in texts]
    every = [grams(w) for w in vocabulary]
    flat = np.concatenate([*every, np.zeros(0, np.int32)])
    ends = np.r_[0, np.cumsum([len(g) for g in every], dtype=np.int64)]
    docs = [np.unique(flat[_ranges(ends, np.unique(w))]) for w in words]
    fold = np.array([zlib.crc32(str(k).encode()) % FOLDS for k in keys])

    def look(lexicon: Lexicon, which: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """What `_seen` gives for the texts, for all words of the vocabulary at once."""
        index = np.full(1 << BITS, -1, np.int32)
        index[lexicon.chosen] = np.arange(len(lexicon.chosen))
        at = index[flat]
        of = np.repeat(np.arange(len(every)), np.diff(ends))[at >= 0]
        held = at[at >= 0].astype(np.int64)
        borders = np.searchsorted(of, np.arange(len(every) + 1))
        speaks = np.diff(borders) > 0
        rows, counts = [], []
        for i in which:
            found, n = np.unique(words[i][speaks[words[i]]], return_counts=True)
            rows.append(np.unique(held[_ranges(borders, found)]))
            counts.append((np.minimum(n, repeats).sum(), len(found), len(words[i])))
        return rows, np.array(counts, np.int64).reshape(-1, 3)

    parts = []
    counts = np.zeros((len(y), 3), np.int64)
    for k in range(FOLDS):
        rest, held = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(set(y[rest])) < 2 or not len(held):
            continue
        lexicon = choose([docs[i] for i in rest], y[rest], most_features)
        rows, c = look(lexicon, np.arange(len(y)))
        counts[held] = c[held]
        parts.append((rest, held, lexicon, rows, c))
    hits = counts[:, 0] * y
    share = hits / np.maximum(counts[:, 2], 1)
    grades = [y * ((share >= np.median(share[y == 1])) & (hits > 0)), y * (hits >= 4), y]
    full = choose(docs, y, most_features)
    rows_full, counts_full = look(full, np.arange(len(y)))
    outside: list[np.ndarray] = []
    weights = []
    for grade in grades:
        oof = np.full(len(y), grade.mean())
        for rest, held, lexicon, rows, c in parts:
            dense = np.c_[_dense(c), *outside]
            w = fit_linear([rows[i] for i in rest], dense[rest], grade[rest], len(lexicon.chosen))
            size = len(lexicon.chosen)
            z = [w[:size][rows[i]].sum() for i in held] + np.c_[dense[held], np.ones(len(held))] @ w[size:]
            oof[held] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        weights.append(fit_linear(rows_full, np.c_[_dense(counts_full), *outside], grade, len(full.chosen)))
        outside.append(oof)
    return Chain(full, weights, repeats)


def fit(docs: DataFrame, labels: DataFrame, most: int = 4000, most_chars: int = 200_000, most_features: int = 4000, repeats: int = 5, key: str = "doc_id", text: str = "text", label: str = "toxic", on_executor: bool = False) -> Chain | None:
    """Trains on a bounded sample of labelled rows: up to `most` of the rows labelled clean and half as many of those
    labelled toxic, the first by a hash of the key; texts of over `most_chars` characters are not learned from. Only keys
    and labels are ranked; texts are read for those chosen. Null keys, labels and texts aren't used.

    `most_features` bounds the hashed features that the chain weighs, `repeats` the hits that one word makes in a text.
    on_executor: the sample is trained on in a task, so that the driver holds the chain only.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("__y"))
    half = [known.where(F.col("__y") == y).orderBy(F.xxhash64(F.lit(3), key), key).limit(n) for y, n in ((0, most), (1, most // 2))]
    chosen = half[0].unionByName(half[1])
    sample = docs.where(F.length(text) <= most_chars).select(key, text).join(F.broadcast(chosen), key).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col("__y").alias("y"))

    def make(rows):
        got = sorted(rows, key=lambda r: (r["k"], r["t"]))
        return train([r["t"] for r in got], [int(r["y"]) for r in got], [r["k"] for r in got], most_features, repeats)

    return in_task(sample, make) if on_executor else make(sample.collect())


_MEMOS: dict[str, Memo] = {}


def toxicity(docs: DataFrame, chain: Chain | None, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """`docs` with a probability column p_<category> for each category of the chain and `toxic`, the decision of its last
    link, which is fed the probabilities of the links before it (p_toxic >= threshold).

    Whole texts, one pass, no shuffle. Null and empty texts, and all texts without a trained chain, get probability 0.
    Every row and column is kept but columns with the names made here, which are replaced; repeated rows and null keys
    are rows like any other; an empty table gives an empty result.
    """
    made = [*(f"p_{c}" for c in CATEGORIES), "toxic"]
    spark = docs.sparkSession
    small_batches(spark)
    names = [c for c in docs.columns if c not in made]
    shared = spark.sparkContext.broadcast(chain)
    name = f"{spark.sparkContext.applicationId}-{np.random.default_rng().integers(1 << 60)}"
    at = names.index(text)

    def run(batches):
        chain = shared.value
        sole_holder("toxicity", _MEMOS.clear)
        if chain is not None and name not in _MEMOS:
            _MEMOS.clear()
            _MEMOS[name] = Memo(lambda w: chain.lexicon.hits(grams(w)), 500_000)
        for b in batches:
            texts = b.column(at).to_pylist()
            p = np.zeros((len(texts), len(CATEGORIES)))
            if chain is not None and texts:
                got = [_seen(WORD.findall(t.lower()) if t else [], _MEMOS[name], chain.repeats) for t in texts]
                p = chain.probabilities([g[0] for g in got], np.array([g[1] for g in got]))
                p[[not g[1][2] for g in got]] = 0
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= threshold)], names=[*names, *made])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), *(f"{c} double" for c in made[:-1]), "toxic boolean"])
    return docs.select(*names).mapInArrow(run, schema)

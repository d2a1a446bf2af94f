"""Operator 9, language identification by a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features (hashed); transitions between the languages of neighbouring
words are learned, on windows of labelled text and on windows spliced from two languages. Forward-backward gives each
word's distribution over languages, exactly and over the whole text; a document's is the mean over its words.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, in_task, small_batches, sole_holder

WORD = re.compile(r"[^\W\d_]+")
BITS = 16
SEGMENT = 32


def features(word: str) -> list[int]:
    """Hashed features of a word in lower case: itself (lexicon), prefixes and suffixes up to 3, n-grams of 2 to 4."""
    w = f"^{word}$".encode()
    n, crc = len(w), zlib.crc32
    grams = {w[i : i + k] for k in (2, 3, 4) for i in range(n - k + 1)}
    named = [b"w" + w, *(b"p" + w[:k] for k in (2, 3, 4)), *(b"s" + w[-k:] for k in (2, 3, 4))]
    return [crc(g) & ((1 << BITS) - 1) for g in (*grams, *named)]


def flat_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lists = [features(w) for w in words]
    return np.concatenate([np.asarray(x, np.int64) for x in lists] or [np.zeros(0, np.int64)]), np.cumsum([0, *map(len, lists)])


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # features x languages
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.langs)))
        flat, ends = flat_features(words)
        return np.add.reduceat(self.weights[flat], ends[:-1], axis=0, dtype=np.float64)


def forward_backward(emit: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Marginals (words x languages) of texts that stand one behind the other in `emit`, `lengths` words each (1 or more).

    Texts are cut into segments that are walked side by side: transfer matrices of all segments first, then the state at
    each segment's borders along each text, then the words within. The same sums as word by word, in fewer numpy steps.
    """
    k = emit.shape[1]
    t = np.exp(transitions - transitions.max())
    e = np.exp(emit - emit.max(1, keepdims=True))
    per_text = -(-lengths // SEGMENT)
    text = np.repeat(np.arange(len(lengths)), per_text)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = np.repeat(np.cumsum(lengths) - lengths, per_text) + number * SEGMENT
    size = np.minimum(SEGMENT, np.repeat(lengths, per_text) - number * SEGMENT)
    order = np.argsort(-size, kind="stable")
    b, s = begin[order], size[order]
    active = [int(np.searchsorted(-s, -step, side="left")) for step in range(SEGMENT)]  # segments longer than step
    across = np.tile(np.eye(k), (len(b), 1, 1))
    for step in range(SEGMENT):
        n = active[step]
        if not n:
            break
        m = (across[:n].reshape(-1, k) @ t).reshape(n, k, k) * e[b[:n] + step][:, None, :]
        across[:n] = m / m.max((1, 2), keepdims=True)
    matrix = np.empty_like(across)
    matrix[order] = across
    entry, leave = np.full((len(b), k), 1.0 / k), np.full((len(b), k), 1.0 / k)
    for step in range(1, int(per_text.max(initial=1))):
        at = np.flatnonzero(number == step)
        v = np.einsum("ni,nij->nj", entry[at - 1], matrix[at - 1])
        entry[at] = v / v.sum(1, keepdims=True)
    left = np.repeat(per_text, per_text) - number
    for step in range(2, int(per_text.max(initial=1)) + 1):
        at = np.flatnonzero(left == step)
        v = np.einsum("nij,nj->ni", matrix[at + 1], leave[at + 1])
        leave[at] = v / v.sum(1, keepdims=True)
    out = np.empty_like(e)
    v = entry[order]
    first = number[order] == 0
    for step in range(SEGMENT):
        n = active[step]
        if not n:
            break
        w = v[:n] @ t
        if step == 0:
            w[first[:n]] = v[:n][first[:n]]  # nothing stands before a text's first word
        w = w * e[b[:n] + step]
        v[:n] = w / w.sum(1, keepdims=True)
        out[b[:n] + step] = v[:n]
    u = leave[order]
    for step in range(SEGMENT - 1, -1, -1):
        n = active[step]
        if not n:
            continue
        p = out[b[:n] + step] * u[:n]
        out[b[:n] + step] = p / p.sum(1, keepdims=True)
        w = (u[:n] * e[b[:n] + step]) @ t.T
        u[:n] = w / w.sum(1, keepdims=True)
    return out


def train(texts: list[str], labels: list[str], window: int = 24, epochs: int = 4, most_windows: int = 6000, seed: int = 5) -> Model | None:
    """A model of the labels' languages; None of none. Conditional log-likelihood by Adagrad over batches of windows."""
    langs = sorted(set(labels))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    windows: dict[int, list[np.ndarray]] = {k: [] for k in range(len(langs))}
    for t, lang in zip(texts, labels, strict=True):
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(t.lower())], np.int64)
        windows[langs.index(lang)] += [ids[i : i + window] for i in range(0, len(ids) - window + 1, window)] or ([np.resize(ids, window)] if len(ids) else [])
    for k, x in windows.items():
        rng.shuffle(x)
        windows[k] = x[: max(1, most_windows // len(langs))]
    pure = [(w, np.full(window, k)) for k, x in windows.items() for w in x]
    model = Model(langs, np.zeros((1 << BITS, len(langs)), np.float32), np.zeros((len(langs), len(langs))))
    if not pure:
        return model
    rows = []
    for w, y in pure:
        rows.append((w, y))
        if len(langs) > 1:
            w2, y2 = pure[rng.integers(len(pure))]
            at = int(rng.integers(2, window - 1))
            rows.append((np.r_[w[:at], w2[at:]], np.r_[y[:at], y2[at:]]))
    flat, ends = flat_features(list(vocabulary))
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    n_l = len(langs)
    g_w, g_t = np.full(model.weights.shape, 1e-6), np.full(model.transitions.shape, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 192):
            part = order[at : at + 192]
            words, back = np.unique(x[part], return_inverse=True)
            back = back.reshape(-1)
            sizes = ends[words + 1] - ends[words]
            f = flat[np.repeat(ends[words] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            emit = np.add.reduceat(model.weights[f], np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
            p, pair = _expected(emit[back].reshape(len(part), window, n_l), model.transitions)
            gold = y[part]
            d = p
            d[np.arange(len(part))[:, None], np.arange(window)[None, :], gold] -= 1
            per_word = np.stack([np.bincount(back, d[:, :, k].reshape(-1), len(words)) for k in range(n_l)], 1) / len(part)
            grad = np.stack([np.bincount(f, np.repeat(per_word[:, k], sizes), 1 << BITS) for k in range(n_l)], 1)
            np.add.at(pair, (gold[:, :-1].reshape(-1), gold[:, 1:].reshape(-1)), -1)
            g_w += grad * grad
            model.weights -= (0.1 * grad / np.sqrt(g_w)).astype(np.float32)
            pair /= len(part)
            g_t += pair * pair
            model.transitions -= 0.1 * pair / np.sqrt(g_t)
    return model


def _expected(emit: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of equally long windows and the expected number of each transition over all of them."""
    n, length, k = emit.shape
    t = np.exp(transitions - transitions.max())
    e = np.exp(emit - emit.max(2, keepdims=True))
    alpha, beta = np.empty_like(e), np.ones_like(e)
    v = e[:, 0]
    alpha[:, 0] = v / v.sum(1, keepdims=True)
    for i in range(1, length):
        v = (alpha[:, i - 1] @ t) * e[:, i]
        alpha[:, i] = v / v.sum(1, keepdims=True)
    pair = np.zeros((k, k))
    for i in range(length - 2, -1, -1):
        w = e[:, i + 1] * beta[:, i + 1]
        joint = alpha[:, i][:, :, None] * t[None] * w[:, None, :]
        pair += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        v = w @ t.T
        beta[:, i] = v / v.sum(1, keepdims=True)
    p = alpha * beta
    return p / p.sum(2, keepdims=True), pair


class Labeller:
    """Word and document labels of a model, with a bounded memo of words' emissions."""

    def __init__(self, model: Model, limit: int = 300_000) -> None:
        self.model, self.limit = model, limit
        self.memo: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.langs)))

    def ids(self, words: list[list[str]]) -> np.ndarray:
        seen = set().union(*words)
        if len(self.memo) + len(seen) > self.limit:
            self.memo.clear()
        todo = [w for w in seen if w not in self.memo]
        if todo:
            at = len(self.memo)
            if at + len(todo) > len(self.table):
                self.table = np.concatenate([self.table[:at], np.zeros((len(todo) + at, len(self.model.langs)))])
            self.table[at : at + len(todo)] = self.model.emissions(todo)
            self.memo.update(zip(todo, range(at, at + len(todo)), strict=True))
        get = self.memo.__getitem__
        return np.fromiter((i for ws in words for i in map(get, ws)), np.int64)

    def marginals(self, texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        words = [WORD.findall(t.lower()) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        if not lengths.sum():
            return [(w, np.zeros((0, len(self.model.langs)))) for w in words]
        ids = self.ids(words)  # may replace the table
        p = forward_backward(self.table[ids], lengths[lengths > 0], self.model.transitions)
        ends = np.cumsum(lengths)
        return [(w, p[e - n : e]) for w, e, n in zip(words, ends.tolist(), lengths.tolist(), strict=True)]

    def documents(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, mean marginal) of each text; ties go to the first name; `und` and 0 of a text without a letter."""
        out = []
        for part in chunks(texts, 1_500_000):
            for words, p in self.marginals(part):
                if any(c.isalpha() for w in words for c in w):
                    mean = p.mean(0)
                    k = int(mean.argmax())
                    out.append((self.model.langs[k], float(min(1.0, mean[k]))))
                else:
                    out.append(("und", 0.0))
        return out


_LABELLERS: dict[str, Labeller] = {}


def _labeller(name: str, broadcast) -> Labeller:
    if name not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[name] = Labeller(broadcast.value)
    return _LABELLERS[name]


def is_held_out(key: str = "doc_id"):
    return (F.crc32(F.col(key).cast("string")) % 5) == 0


def fit(docs: DataFrame, per_lang: int = 250, most_langs: int = 200, most_chars: int = 200_000, key: str = "doc_id", text: str = "text", lang: str = "lang", on_executor: bool = False) -> Model | None:
    """Trains on documents that aren't held out and have a language: `per_lang` documents of each language (the bound of
    the sample), the first by a hash of the key. Texts of over `most_chars` characters are not learned from, and more than
    `most_langs` languages are an error. Only keys and languages are ranked; texts are read for those chosen. on_executor:
    the sample is trained on in a task, so that the driver holds the model only."""
    named = docs.where(~is_held_out(key) & F.col(lang).isNotNull() & (F.length(text) <= most_chars))
    ranked = named.select(key, lang, F.xxhash64(F.lit(11), key).alias("__h"))
    if ranked.select(lang).distinct().limit(most_langs + 1).count() > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    # Each task keeps its first rows of a language before the shuffle, so no language's rows meet in one task.
    order = Window.partitionBy(lang).orderBy("__h", key)
    chosen = ranked.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_lang).select(key).distinct()
    sample = named.join(F.broadcast(chosen), key, "left_semi").select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))

    def make(rows):
        got = sorted(rows, key=lambda r: (r["k"], r["l"], r["t"]))
        return train([r["t"] for r in got], [r["l"] for r in got])

    return in_task(sample, make) if on_executor else make(sample.collect())


def identified(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with columns lang_pred and lang_score; only the text is read for them. Map-only.

    Null texts and texts without a letter are `und` with score 0, and so is everything if there was nothing to learn
    from. Every row and column is kept but columns with the two names made here, which are replaced; repeated rows each
    give a row; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made = ["lang_pred", "lang_score"]
    names = [c for c in docs.columns if c not in made]
    at = names.index(text)
    shared = spark.sparkContext.broadcast(model)
    name = f"{spark.sparkContext.applicationId}-{np.random.default_rng().integers(1 << 60)}"

    def run(batches):
        sole_holder("langcrf", _LABELLERS.clear)
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            got = [("und", 0.0)] * len(texts) if shared.value is None else _labeller(name, shared).documents(texts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, *made])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names).mapInArrow(run, f"{schema}, lang_pred string, lang_score double")


def languages(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score) per row of `docs`, as `identified` finds them; null keys are not held out."""
    held = F.coalesce(is_held_out(key), F.lit(False)).alias("held_out")
    return identified(docs.select(key, text), model, text).select(F.col(key), held, "lang_pred", F.col("lang_score").alias("score"))


def word_spans(text: str, model: Model) -> list[tuple[int, int, str]]:
    """(start, end, language) of maximal runs of words with one most likely language: the labels of code-switched text."""
    places = [m.span() for m in WORD.finditer(text.lower())] if len(text.lower()) == len(text) else [m.span() for m in WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in places]
    if not words:
        return []
    p = forward_backward(model.emissions(words), np.array([len(words)]), model.transitions)
    out: list[tuple[int, int, str]] = []
    for (a, b), k in zip(places, p.argmax(1).tolist(), strict=True):
        if out and out[-1][2] == model.langs[k]:
            out[-1] = (out[-1][0], b, model.langs[k])
        else:
            out.append((a, b, model.langs[k]))
    return out

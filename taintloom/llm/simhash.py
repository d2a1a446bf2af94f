"""Operator 10, SimHash near-dedup by anchor-point covering.

Anchors are the codewords of a product of perfect codes (Golay and Hamming blocks) that covers the whole fingerprint
space within radius R. Two fingerprints at distance t or less have a point between them that lies within r = ceil(t / 2)
of both, and that point has an anchor within R. So both fingerprints are within R + r of that anchor. Each fingerprint
is replicated to every anchor within that distance (the threshold counts half: the other half would add replicas but no
link), and fingerprints are compared per anchor only. No link is lost: it is a covering, not a sketch.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Scratch, cells, cut, small_batches, sole_holder
from .components import components

GOLAY = 0b110001110101  # fixed value: generator polynomial of the binary Golay code of length 23
#: Block lengths that cover a fingerprint of so many bits: 23 is Golay (radius 3), 2^m - 1 is Hamming (radius 1).
BLOCKS = {64: (23, 23, 15, 3), 30: (23, 7)}


@functools.lru_cache(maxsize=16)
def _block(length: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a perfect code: two syndrome tables (low 12 bits, the rest), and for each syndrome the error patterns up to
    `reach` beyond the covering radius, padded with -1, with how far beyond it they are."""
    if length == 23:
        radius, column = 3, []
        for i in range(23):
            v = 1 << i
            for k in range(22, 10, -1):
                if v >> k & 1:
                    v ^= GOLAY << (k - 11)
            column.append(v)
    else:
        radius, column = 1, list(range(1, length + 1))
    low, high = (functools.reduce(lambda t, c: np.concatenate([t, t ^ c]), part, np.zeros(1, np.int64)) for part in (column[:12], column[12:]))
    found: dict[int, list[tuple[int, int]]] = {}
    for weight in range(radius + reach + 1):
        for places in itertools.combinations(range(length), weight):
            s = functools.reduce(lambda a, i: a ^ column[i], places, 0)
            found.setdefault(s, []).append((sum(1 << i for i in places), max(0, weight - radius)))
    width = max(map(len, found.values()))
    patterns, beyond = np.full((len(found), width), -1, np.int64), np.full((len(found), width), 99, np.int64)
    for s, x in found.items():
        patterns[s, : len(x)], beyond[s, : len(x)] = [p for p, _ in x], [b for _, b in x]
    return low, high, patterns, beyond


def anchors(prints: np.ndarray, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor that a fingerprint (uint64) is replicated to, so that any two fingerprints at most
    `most` bits apart share one."""
    reach = -(-most // 2)
    row, made, left = np.arange(len(prints)), np.zeros(len(prints), np.uint64), np.full(len(prints), reach)
    shift = 0
    for length in BLOCKS[bits]:
        low, high, patterns, beyond = _block(length, reach)
        v = (prints[row] >> np.uint64(shift)).astype(np.int64) & ((1 << length) - 1)
        s = low[v & 0xFFF] ^ high[v >> 12]
        ok = beyond[s] <= left[:, None]
        at, k = np.nonzero(ok)
        made = made[at] | ((v[at] ^ patterns[s[at], k]).astype(np.uint64) << np.uint64(shift))
        left = left[at] - beyond[s[at], k]
        row = row[at]
        shift += length
    return row, made


def shingle_hashes(text: str, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of `width` words, repeats included; of the whole sequence if there are fewer; words are what
    ASCII white space parts, A-Z in lower case."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) > width else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(r, seed) for r in runs), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The SimHash: a bit is 1 if it is set in over half of the hashes; zero of none."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        count += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long): the 64-bit fingerprint, as a signed number, of every row's whole text. Map-only."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            fp = np.array([majority(shingle_hashes(t or "", width)) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[key, "fp"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, fp long")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of whole runs of equal keys from sorted batches, and where runs start. A cell is at most one run, and
    cells are bounded, so what is carried over is."""
    kept: pa.Table | None = None
    for b in itertools.chain(batches, [None]):
        t = kept if b is None else pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
        if t is None or not t.num_rows:
            continue
        columns = [c.to_numpy() for c in t.columns]
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            x = columns[t.column_names.index(k)]
            new[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(new)
        if b is None:
            yield columns, starts
        else:
            kept = t.slice(int(starts[-1])).combine_chunks()
            if len(starts) > 1:
                yield [c[: starts[-1]] for c in columns], starts[:-1]


def spanning(distance: np.ndarray, near: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of least distances among points, by Prim's method; none is longer than `near`."""
    n = len(distance)
    best, origin, out = np.full(n, near + 1), np.full(n, -1), []
    free = np.ones(n, bool)
    for _ in range(n):
        i = int(np.argmin(np.where(free, best, near + 2)))
        if origin[i] >= 0 and best[i] <= near:
            out.append((int(origin[i]), i))
        free[i] = False
        d = distance[i]
        closer = free & (d < best)
        best[closer], origin[closer] = d[closer], i
    return out


def tables_of(column: np.ndarray, bits: int) -> list[np.ndarray]:
    """The fingerprints in a column of longs: one of 64 bits, or two of up to 32 bits, one in either half."""
    c = column.view(np.uint64)
    return [c] if bits > 32 else [c & np.uint64(0xFFFFFFFF), c >> np.uint64(32)]


def cell_links(rows: DataFrame, prints: list[str], bits: int, most: int, near: int, cell_rows: int = 1000) -> DataFrame:
    """Links (a, b) per anchor: a spanning forest of every anchor's nodes, linear in them, instead of all their pairs.

    `rows`: anchor long, node long, and the fingerprint columns `prints`. Nodes link where one print is at most `most`
    bits apart (the one `anchor` was made from shares its cell) and all prints together at most `near`.
    """
    keys = ["anchor", "cell_i", "cell_j"]
    dealt = cells(rows, ["anchor"], ["node"], cell_rows).select(*keys, "node", *prints)
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "node")

    def run(batches):
        for columns, starts in _runs(batches, keys):
            node, sig = columns[3], [t for c in columns[4:] for t in tables_of(c, bits)]
            sizes = np.diff(np.r_[starts, len(node)])
            a, b = [], []
            two = starts[sizes == 2]
            each = [np.bitwise_count(s[two] ^ s[two + 1]).astype(int) for s in sig]
            two = two[(sum(each) <= near) & (np.min(each, axis=0) <= most)]
            a.append(node[two]), b.append(node[two + 1])
            for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                part = [s[at : at + n] for s in sig]
                total, least = np.zeros((n, n), np.int32), np.full((n, n), 99, np.int32)
                for s in part:
                    d = np.bitwise_count(s[:, None] ^ s[None, :]).astype(np.int32)
                    total += d
                    np.minimum(least, d, out=least)
                total[least > most] = near + 1
                if np.count_nonzero(total <= near) > n:
                    edges = np.array(spanning(total, near), np.int64).reshape(-1, 2)
                    a.append(node[at + edges[:, 0]]), b.append(node[at + edges[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def replicated(points: DataFrame, prints: list[str], bits: int, most: int) -> DataFrame:
    """A row for each point (node, prints...) and anchor; every table of fingerprints has anchors of its own."""

    def run(batches):
        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            for k, table in enumerate(t for c in columns[1:] for t in tables_of(c, bits)):
                row, made = anchors(table, bits, most)
                key = made.view(np.int64) | np.int64(k << bits if bits <= 32 else 0)
                for at in range(0, len(row), 100_000):
                    r = row[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(key[at : at + 100_000]), *(pa.array(c[r]) for c in columns)], names=["anchor", "node", *prints])

    return points.select("node", *prints).mapInArrow(run, "anchor long, node long, " + ", ".join(f"{p} long" for p in prints))


def simhash_components(docs: DataFrame, width: int = 3, most: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint hex, component_id) of every row of `docs`; fingerprints link at `most` or fewer differing bits.

    Equal fingerprints are one point from the start (summed map-side), so exact copies cost nothing further. Null and
    empty texts have fingerprint zero and link like any other. Rows that repeat a key are one document; a null key gets
    the smallest key of its component, or null if there is none. An empty table gives an empty result; extra columns
    are not read. The key must be an integer.
    """
    prints = cut(fingerprints(docs, width, key, text).withColumnRenamed(key, "doc"))
    points = cut(prints.groupBy("fp").agg(F.min("doc").cast("long").alias("node")))
    edges = cell_links(replicated(points.where("node is not null"), ["fp"], 64, most), ["fp"], 64, most, most)
    roots = components(edges)
    of = points.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(of, "fp").select(F.col("doc").alias(key), shown, "component_id")


_WORDS: dict[str, Memo] = {}
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words (as in `shingle_hashes`); a worker keeps those that it has met, a bounded number."""
    if "words" not in _WORDS:
        sole_holder("simhash", _WORDS.clear)
        _WORDS["words"] = Memo(xxhash.xxh64_intdigest, 300_000)
    words = text.encode().lower().split()
    return np.fromiter(map(_WORDS["words"].__getitem__, words), np.uint64, len(words))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes, sorted, of every run of `width` words, or of the whole sequence if there are fewer: made of the words'
    hashes, all runs at once."""
    if not len(words):
        return words
    width = min(width, len(words))
    h = words[: len(words) - width + 1].copy()
    for k in range(1, width):
        h = h * _BASE + words[k : len(words) - width + 1 + k]
    for shift, factor in ((33, _MIX[0]), (29, _MIX[1])):
        h = (h ^ (h >> np.uint64(shift))) * factor
    return np.unique(h ^ (h >> np.uint64(32)))


def parity(found: np.ndarray) -> np.ndarray:
    """256 bits, as four longs, of a set of hashes: a bit is the parity of the number of hashes that fall on it. Two sets
    differ in as many hashes as their bits do, or in more."""
    odd = np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


#: Bits of a table that marks hashes. More hashes than that only make its answers less sharp; none depends on them.
SLOTS = 1 << 26


def marked(hashes: DataFrame, column: str) -> np.ndarray:
    """A table of SLOTS bits with those of a column's hashes set: a bounded number of words reaches the driver."""
    slot = F.expr(f"`{column}` & {SLOTS - 1}L").alias("slot")
    words = hashes.select(slot).groupBy(F.expr("shiftright(slot, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    marks = np.zeros(SLOTS >> 6, np.uint64)
    marks[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return marks


def in_marks(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(SLOTS - 1)
    return (marks[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def shingle_prefix(found: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes of a set (sorted), those marked in `common` being last in order, that are enough to hold one of any
    set of `similarity` or more to it."""
    last = in_marks(common, found)
    return np.concatenate([found[~last], found[last]])[: len(found) - math.ceil(similarity * len(found) - 1e-9) + 1]


def common_shingles(docs: DataFrame, width: int, part: int = 16) -> np.ndarray:
    """Marks of the hashes that two documents of one in `part` hold. They only settle an order: any choice gives the same
    result, but with common ones last few documents meet by them."""

    def run(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(word_hashes(t), width).view(np.int64))], names=["token"])

    some = docs.where(F.pmod(F.xxhash64("doc"), F.lit(part)) == 0).select("text")
    return marked(some.mapInArrow(whole_batches(run), "token long").groupBy("token").count().where("count > 1"), "token")


def prefix_pairs(docs: DataFrame, nodes: DataFrame, width: int, similarity: float, scratch: Scratch, cell_rows: int = 1000) -> DataFrame:
    """Pairs (a, b) of nodes of different groups among which every pair with a Jaccard similarity of `similarity` or more
    is: an exact prefix-filter join with length, positional and parity filters, and one of counts by 256
    parts of the hash range: sets differ in as many hashes as their counts differ in all, or in more.

    `docs`: doc, text; `nodes`: node, comp (its group), s0 to s3 (its parity sketch). A first pass marks prefix hashes of two
    texts or more in a table of bits; the second passes on rows of those only.
    """
    context = docs.sparkSession.sparkContext
    order = context.broadcast(common_shingles(docs, width))

    def tokens(batches):
        for b in batches:
            for t in b.column(1).to_pylist():
                p = shingle_prefix(shingle_set(word_hashes(t), width), order.value, similarity)
                own = xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(np.full(len(p), own, np.int64))], names=["token", "own"])

    met = docs.mapInArrow(whole_batches(tokens), "token long, own long").groupBy("token").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least < most")
    shared = context.broadcast(marked(met, "token"))

    def places(batches):
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = shingle_set(word_hashes(t), width)
                p = shingle_prefix(found, order.value, similarity)
                at = np.flatnonzero(in_marks(shared.value, p))
                columns = [p[at].view(np.int64), np.full(len(at), d, np.int64), np.full(len(at), len(found), np.int32), at.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "size", "place"])

    rows = scratch.keep(docs.mapInArrow(whole_batches(places), "token long, node long, size int, place int").join(nodes.select("node", "comp"), "node"))
    across = scratch.keep(rows.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("token"))
    rows = scratch.keep(rows.join(across, "token", "left_semi").join(nodes.drop("comp"), "node"))
    keys = ["token", "cell_i", "cell_j"]
    dealt = cells(rows, ["token"], ["node"], cell_rows).select(*keys, "node", "comp", "size", "place", "s0", "s1", "s2", "s3")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "node")

    def run(batches):
        for columns, starts in _runs(batches, keys):
            node, comp, size, place, *sketch = columns[3:]
            size, place = size.astype(np.int64), place.astype(np.int64)
            end = np.repeat(np.r_[starts[1:], len(node)], np.diff(np.r_[starts, len(node)]))
            i, far = np.arange(len(node)), 0
            while len(i):
                far += 1
                i = i[i + far < end[i]]
                x = i[comp[i] != comp[i + far]]
                y = x + far
                need = np.ceil(similarity / (1 + similarity) * (size[x] + size[y]) - 1e-9).astype(np.int64)
                ok = np.minimum(size[x] - place[x], size[y] - place[y]) >= need
                ok &= np.minimum(size[x], size[y]) >= need
                ok &= sum(np.bitwise_count(s[x] ^ s[y]).astype(np.int64) for s in (c.view(np.uint64) for c in sketch)) <= size[x] + size[y] - 2 * need
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x[ok]], node[y[ok]])), pa.array(np.maximum(node[x[ok]], node[y[ok]]))], names=["a", "b"])

    pairs = scratch.keep(dealt.mapInArrow(run, "a long, b long").where("a <> b").distinct())
    wanted = context.broadcast(marked(pairs.select(F.explode(F.array(F.xxhash64("a"), F.xxhash64("b"))).alias("h")), "h"))

    def counts(batches):
        for b in batches:
            keep = in_marks(wanted.value, b.column(2).to_numpy().view(np.uint64))
            part = b.filter(pa.array(keep))
            found = [shingle_set(word_hashes(t), width) for t in part.column(1).to_pylist()]
            held = [np.minimum(np.bincount((f >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array(held, pa.binary())], names=["doc", "size", "held"])

    def close(batches):
        for b in batches:
            a, c, x, y = (b.column(k).to_numpy() for k in range(4))
            apart = [np.abs(np.frombuffer(p, np.uint8).astype(int) - np.frombuffer(q, np.uint8)).sum() for p, q in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            need = np.ceil(similarity / (1 + similarity) * (x + y) - 1e-9)
            ok = np.array(apart) <= x + y - 2 * need
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(c[ok])], names=["a", "b"])

    held = scratch.keep(docs.withColumn("h", F.xxhash64("doc")).mapInArrow(counts, "doc long, size long, held binary").dropDuplicates(["doc"]))
    left, right = (held.select(F.col("doc").alias(c), F.col("size").alias(f"{c}_size"), F.col("held").alias(f"{c}_held")) for c in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_size", "b_size", "a_held", "b_held")
    return cut(both.mapInArrow(close, "a long, b long"))


def whole_batches(make, rows: int = 50_000):
    """Joins the many small batches that `make` yields into some of about `rows` rows."""

    def run(batches):
        kept, size = [], 0
        for b in make(batches):
            kept.append(b)
            size += b.num_rows
            if size >= rows:
                yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
                kept, size = [], 0
        if kept:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()

    return run


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, tables: int = 6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, root) of every document that has a copy: root is the smallest key of its group, in groups linked by equal
    texts or by a Jaccard similarity of `similarity` or more between sets of `width`-word shingles.

    Most are found by `tables` (2, 4 or 6) 30-bit SimHashes of the set of word pairs, each within 2 bits by anchor covering: pairs of
    words change less than longer shingles, so near copies are close in one of the tables. Per anchor the spanning forest of
    least distance over all tables' bits is kept, and its edges are verified exactly. What that leaves apart, `prefix_pairs`
    finds without loss between the groups made so far, so the result is that of comparing all pairs.

    Null, empty and blank texts and rows without a key are never copies. Rows that repeat a key are one document: of
    several texts, the one with the smallest hash stands for it. An empty table gives an empty result; extra columns,
    whatever their names, are not read. The key must be an integer.
    """
    small_batches(docs.sparkSession)
    prints, sketch = [f"p{k}" for k in range(-(-tables // 2))], ["s0", "s1", "s2", "s3"]
    docs = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null and trim(text) <> ''")
    hashed = F.xxhash64(F.lit(3), "text")
    several = cut(docs.groupBy("doc").agg(F.min(hashed).alias("low"), F.max(hashed).alias("high")).where("low <> high").select("doc", "low"))
    if not several.isEmpty():
        docs = docs.join(several, "doc", "left").where(F.col("low").isNull() | (hashed == F.col("low"))).select("doc", "text")

    def sign(batches):
        for b in batches:
            rows = ([], [], [], *([] for _ in prints), *([] for _ in sketch))
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = word_hashes(t)
                h = shingle_set(words, 2)
                wide = [majority(h), majority((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)), majority((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9))]
                digest = xxhash.xxh3_128_intdigest(t.encode())
                rows[0].append(d)
                rows[1].append((digest >> 64) - (1 << 63))
                rows[2].append((digest & ((1 << 64) - 1)) - (1 << 63))
                for k, column in enumerate(rows[3 : 3 + len(prints)]):
                    column.append(wide[k] & 0x3FFFFFFF3FFFFFFF)
                for column, s in zip(rows[3 + len(prints) :], parity(shingle_set(words, width)).tolist(), strict=True):
                    column.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc", "h1", "h2", *prints, *sketch])

    signed = cut(docs.mapInArrow(sign, "doc long, h1 long, h2 long, " + ", ".join(f"{p} long" for p in [*prints, *sketch])))
    texts = cut(signed.groupBy("h1", "h2").agg(F.min("doc").alias("node"), *(F.first(p).alias(p) for p in [*prints, *sketch])))
    edges = cut(cell_links(replicated(texts, prints, 30, 2), prints, 30, 2, 6 * tables))

    def verified(edges):
        """The edges whose documents' sets are similar enough. Sets are made of the documents that have an edge."""
        wanted = docs.sparkSession.sparkContext.broadcast(marked(edges.select(F.explode(F.array(F.xxhash64("a"), F.xxhash64("b"))).alias("h")), "h"))

        def sets(batches):
            for b in batches:
                part = b.filter(pa.array(in_marks(wanted.value, b.column(2).to_numpy().view(np.uint64))))
                found = [shingle_set(word_hashes(t), width).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc", "shingles"])

        with Scratch(docs.sparkSession) as scratch:
            shingles = scratch.keep(docs.withColumn("h", F.xxhash64("doc")).mapInArrow(sets, "doc long, shingles array<long>").dropDuplicates(["doc"]))
            left, right = (shingles.select(F.col("doc").alias(c), F.col("shingles").alias(f"{c}_set")) for c in ("a", "b"))
            both = F.size(F.array_intersect("a_set", "b_set"))
            return cut(edges.join(left, "a").join(right, "b").where(both >= similarity * (F.size("a_set") + F.size("b_set") - both)).select("a", "b"))

    similar = verified(edges)
    of = cut(texts.join(components(similar), "node", "left").select("node", F.coalesce("root", "node").alias("comp"), *sketch))
    with Scratch(docs.sparkSession) as scratch:
        apart = prefix_pairs(docs, of, width, similarity, scratch)
    if not apart.isEmpty():
        similar = similar.union(verified(apart))
    same = signed.join(texts.select("h1", "h2", "node"), ["h1", "h2"]).where("doc <> node").select(F.col("node").alias("a"), F.col("doc").alias("b"))
    return components(similar.union(same)).withColumnRenamed("node", key)

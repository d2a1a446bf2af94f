"""Operator 2, best-fit packing: hierarchical residual packing of token pieces into sequences.

Partitions pack their pieces best-fit by themselves and emit bins that are nearly full: no piece or bin that is left
fits in. Underfull bins become items of the next round, in fewer and larger groups (a tree); its root packs what is left
as one group, by counts of fills. A bin carries its pieces, so nothing has to be joined again; a group holds a bounded
number of bins and of pieces.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, sole_holder, tokenizer_path

ITEM = "array<struct<doc_id:{k},piece:int,start:long,length:long,ids_crc32:long,at:long>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the items of each bin: largest items first, each into the fullest bin that still takes it.

    Bins are kept by the room that they have left, so an item costs a search over at most `capacity` rooms.
    """
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        bins[b].append(i)
        left = room - size
        if left:
            if left not in by_room:
                by_room[left] = []
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


#: A full stop or comma that ends a longer run of punctuation, which the tokenizer takes as one word.
_RUN_END = re.compile(r"(?:[^\w \t\r\n]|_)[.,] ")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, by the tokenizers library.

    The tokenizer drops white space, and no token goes across it or between a letter and a full stop. So a text is cut
    at blanks and newlines; parts are encoded by the library once and kept in a memo of at most `limit` parts. Texts in
    Latin-1, where lower case and composition work letter by letter as in the library, share parts across case and
    before full stops and commas. Words of letters only are encoded many to a call and told apart by their end mark.
    """

    def __init__(self, path: str, limit: int = 700_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        ids = self.tok.get_vocab()
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        self.ends[[i for token, i in ids.items() if token.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}
        self.limit = limit

    @staticmethod
    def parts(text: str) -> list[str]:
        t = text.replace("\n", " ")
        if "<|" not in t:
            try:
                t.encode("latin-1")
            except UnicodeEncodeError:
                return t.split(" ")
            t = t.lower() + " "
            if not _RUN_END.search(t):
                t = t.replace(". ", " . ").replace(", ", " , ")
        return t.split(" ")

    def learn(self, words: list[str]) -> None:
        if len(self.memo) + len(words) > self.limit:
            self.memo.clear()
        letters = [w for w in words if w.isalpha()]
        for k in range(0, len(letters), 50_000):
            self._learn_letters(letters[k : k + 50_000])
        rest = [w for w in words if w not in self.memo]
        for w, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.memo[w] = array("I", e.ids).tobytes()

    def _learn_letters(self, words: list[str]) -> None:
        got = self.tok.encode_batch_fast([" ".join(words[i : i + 500]) for i in range(0, len(words), 500)], add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, "<u4") for e in got])
        ends = ((np.flatnonzero(self.ends[flat]) + 1) * 4).tolist()
        if len(ends) == len(words):  # else some word is several words to the tokenizer: each by itself, then
            raw = flat.tobytes()
            self.memo.update(zip(words, (raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.parts(t) for t in texts]
        got = [list(map(self.memo.get, ws)) for ws in split]
        missing = {ws[i] for ws, g in zip(split, got, strict=True) for i in _places(g)}
        if missing:
            self.learn(list(missing))
            for ws, g in zip(split, got, strict=True):
                for i in _places(g):
                    g[i] = self.memo[ws[i]]
        return [b"".join(g) for g in got]


def _places(values: list) -> Iterator[int]:
    at = -1
    try:
        while True:
            at = values.index(None, at + 1)
            yield at
    except ValueError:
        return


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as token pieces of at most `capacity` ids; only longer documents are cut. Map-only."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    end = array("I", [end_id]).tobytes()

    def run(batches):
        sole_holder("packing", encoder.cache_clear)
        for b in batches:
            keys, out = b.column(0), ([], [], [], [], [])
            for n, ids in enumerate(encoder(path).encode([t or "" for t in b.column(1).to_pylist()])):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (n, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fit_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The best fit of `best_fit` for so many items of each size, told as runs (size, rank, n, bin, at): the n items of a
    size from that rank on go to the n bins from `bin` on, one to each, at offset `at`.

    Equal items and equal bins move together, so this costs what there are sizes and rooms, whatever the number of items.
    """
    by_room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    runs: list[tuple[int, int, int, int, int]] = []

    def place(size: int, rank: int, bins: int, each: int, first: int, room: int) -> int:
        """`each` items into each of `bins` equal bins, and how many items that are."""
        runs.extend((size, rank + j * bins, bins, first, capacity - room + j * size) for j in range(each))
        left = room - each * size
        if left:
            if left not in by_room:
                by_room[left] = []
                bisect.insort(rooms, left)
            by_room[left].append((first, bins))
        return bins * each

    next_bin = 0
    for size in sorted(counts, reverse=True):
        rank, n = 0, counts[size]
        while n:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                room, first, bins = capacity, next_bin, -(-n // (capacity // size))
                next_bin += bins
            else:
                room = rooms[at]
                first, bins = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            each = room // size
            full = min(bins, n // each)
            done = place(size, rank, full, each, first, room) if full else 0
            if full < bins:
                rest = n - done  # fewer than one bin takes; the bins behind it stay as they are
                done += place(size, rank + done, 1, rest, first + full, room) if rest else 0
                full += bool(rest)
                if full < bins:
                    place(size, 0, bins - full, 0, first + full, room)
            rank, n = rank + done, n - done
    return runs


def _moved(items: pa.ListArray, order: np.ndarray, shift: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """Lists of `items` in that order, their places moved by `shift`, and `lengths` neighbours joined to one list each."""
    starts = items.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(starts)[order]
    ends = np.cumsum(sizes)
    taken = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[:-1][order] - ends + sizes, sizes)
    flat = items.values.take(pa.array(taken))
    fields = [pa.field(f.name, f.type, True) for f in flat.type]
    columns = [pa.array(flat.field(f.name).to_numpy() + np.repeat(shift, sizes)) if f.name == "at" else flat.field(f.name) for f in fields]
    borders = np.r_[0, ends][np.r_[0, np.cumsum(lengths)]]
    moved = pa.StructArray.from_arrays(columns, fields=fields)
    return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), moved, type=pa.list_(pa.field("element", moved.type)))


def _list_column(column: pa.ChunkedArray) -> pa.ListArray:
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _packer(level: int, capacity: int, least: int):
    """One best-fit round over a group (g, h, fill, items): its new bins with their pieces. Pieces stay in Arrow."""

    def run(keys, t):
        t = t.sort_by([("fill", "descending"), ("h", "ascending")])
        sizes = t["fill"].to_numpy()
        bins = best_fit(sizes.tolist(), capacity)
        lengths = np.array([len(b) for b in bins])
        order = np.concatenate([np.array(b, np.int64) for b in bins])
        filled = np.cumsum(sizes[order])
        total = np.add.reduceat(sizes[order], np.cumsum(lengths) - lengths)
        shift = filled - sizes[order] - np.repeat(np.cumsum(total) - total, lengths)
        ids = np.arange(len(bins)) | (level << 56) | (keys[0].as_py() << 28)
        return pa.table({"sequence_id": ids, "fill": total, "done": total >= least, "items": _moved(_list_column(t["items"]), order, shift, lengths)})

    return run


def _root(left: DataFrame, schema: str, capacity: int, groups: int) -> DataFrame:
    """All bins of `left` packed as one group: their fills are counted, the counts are packed on the driver (at most
    `capacity` numbers), and each bin goes to its place by its rank among the bins of its fill. Nothing is in one task."""
    counts = {r["fill"]: r["count"] for r in left.groupBy("fill").count().collect()}
    runs = np.array(sorted(fit_counts(counts, capacity)), np.int64).reshape(-1, 5)
    shared = left.sparkSession.sparkContext.broadcast(runs)
    left = left.withColumn("g", F.pmod(F.xxhash64(F.lit(3), "sequence_id"), F.lit(groups)).cast("int"))
    before = Window.partitionBy("fill").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # a row for each group
    first = left.groupBy("g", "fill").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).select("g", "fill", "first")

    def run(keys, t):
        t = t.sort_by([("fill", "ascending"), ("sequence_id", "ascending")])
        fill = t["fill"].to_numpy()
        rank = t["first"].to_numpy() + np.arange(len(fill)) - np.searchsorted(fill, fill)
        runs = shared.value
        at = np.searchsorted((runs[:, 0] << 48) | runs[:, 1], (fill << 48) | rank, "right") - 1
        where = runs[at]
        items = _moved(_list_column(t["items"]), np.arange(len(fill)), where[:, 4], np.ones(len(fill), np.int64))
        return pa.table({"sequence_id": (60 << 56) | (where[:, 3] + rank - where[:, 1]), "fill": fill, "done": np.ones(len(fill), bool), "items": items})

    return cut(left.join(first, ["g", "fill"]).groupBy("g").applyInArrow(run, schema))


def pack(parts: DataFrame, capacity: int = 2048, nearly: float = 1.0, group_items: int = 20_000, group_pieces: int = 400_000, fan_in: int = 8) -> DataFrame:
    """Adds (sequence_id, offset) to pieces (doc_id, piece, start, length, ids_crc32), each at most `capacity` long.

    Pieces of full length are sequences of their own. Round 0 groups the others by a hash of (doc_id, piece), about
    `group_items` to a group, so a hot source or one very long document spreads. After a round, bins that are full to
    the share `nearly`, or that have less room than the smallest bin left, are emitted; the others are items of the next
    round, in groups of `fan_in` joined ones, or as many as hold at most about `group_items` bins and `group_pieces`
    pieces. Rounds go on while each at least halves the number of groups. The root of the tree then packs all that is
    left as one group, by counts of fills, so nothing is left unmerged at any size.

    Repeated rows are packed each; ties go by a hash; null ids are ids like any other; an empty table gives an empty
    result. The columns named above are all that is kept.
    """
    kind = parts.schema["doc_id"].dataType.simpleString()
    least = int(capacity * nearly)
    schema = f"sequence_id long, fill long, done boolean, items {ITEM.format(k=kind)}"
    parts = cut(parts.select("doc_id", "piece", "start", "length", "ids_crc32"))
    whole = parts.where(F.col("length") == capacity).select("*", ((F.lit(1 << 62)) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    whole = cut(whole)  # the number of a row must not change if a task runs again
    rest = parts.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_items))
    one = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("at"))
    open_bins = rest.select(F.xxhash64("doc_id", "piece", "ids_crc32").alias("h"), F.col("length").alias("fill"), F.array(one).alias("items"))
    results, level = [], 0
    while True:
        g = F.pmod("h", F.lit(groups)).cast("int").alias("g")
        packed = cut(open_bins.select(g, "h", "fill", "items").groupBy("g").applyInArrow(_packer(level, capacity, least), schema))
        if groups == 1:
            results.append(packed)
            break
        left = packed.where(~F.col("done"))
        smallest = left.agg(F.min("fill")).first()[0]
        stays = F.col("done") | (F.col("fill") > capacity - (smallest or 0))
        results.append(packed.where(stays))
        left = packed.where(~stays)
        bins, pieces_left = left.agg(F.count("*"), F.sum(F.size("items"))).first()
        if not bins:
            break
        bounded = max(-(-bins // group_items), -(-pieces_left // group_pieces))
        fewer = max(1, -(-groups // fan_in), bounded)
        if 2 * fewer > groups:
            results.append(_root(left, schema, capacity, bounded))
            break
        open_bins = left.select(F.xxhash64("sequence_id").alias("h"), "fill", "items")
        groups, level = fewer, level + 1
    bins = functools.reduce(DataFrame.unionByName, results)
    placed = bins.select("sequence_id", F.inline("items")).withColumnRenamed("at", "offset")
    return placed.select(*parts.columns, "sequence_id", "offset").unionByName(whole)


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = 2048) -> DataFrame:
    """Whole texts (null: empty) of `docs` as pieces in as few sequences as the rounds find.

    Every row is packed, so rows that repeat a key or a text give their pieces each; null keys are kept as they are;
    empty texts are one piece with the end id only; equal lengths are told apart by a hash; an empty table gives an
    empty result. Other columns of `docs`, whatever their names, aren't read.
    """
    return pack(pieces(docs, path or tokenizer_path("word_bpe_49k.json"), capacity), capacity)

"""Packing, codec and token counts against the public libraries."""

import hashlib
import random
import zlib
from array import array
from collections import Counter, defaultdict

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from taintloom.llm import packing, piece_codec, piece_count
from taintloom.llm.common import tokenizer_path

from .helpers import awkward, none

PIECES = tokenizer_path("piece_bpe_32k.model")
WORDS = tokenizer_path("word_bpe_49k.json")
SP = sentencepiece.SentencePieceProcessor(model_file=PIECES)
TOK = Tokenizer.from_file(WORDS)
ODD = st.lists(st.sampled_from(["a", "b", "th", "the", "T", " ", "  ", "\n", "\t", "▁", "é", "É", "ß", "日", "😀", "́", "1", "²", ".", ", ", ". ", "!!", "'s", "<s>", "</s>", "<0x0A>", "<|endoftext|>", "\x00", "\x1c", "\x85", " ", "İ", "Σ"]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_codec_and_counts_equal_the_library(text):
    codec = piece_codec.codec(PIECES)
    want = SP.encode(text)
    assert codec.encode(text) == want
    assert piece_count.count_text(text, PIECES) == len(want)
    assert codec.decode(want) == SP.decode(want)


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_packing_ids_equal_the_library(text):
    got = packing.encoder(WORDS).encode([text])[0]
    assert array("I", got).tolist() == TOK.encode(text, add_special_tokens=False).ids


def test_long_runs():
    rng = random.Random(7)
    for alphabet in ("a", "ab", "abc", "the "):
        t = "".join(rng.choice(alphabet) for _ in range(4000))
        assert piece_codec.codec(PIECES).encode(t) == SP.encode(t)
        assert piece_count.count_text(t, PIECES) == len(SP.encode(t))


def test_decode_of_any_ids():
    rng = random.Random(11)
    for _ in range(200):
        ids = [rng.randrange(3, 32000) for _ in range(rng.randrange(8))]
        assert piece_codec.codec(PIECES).decode(ids) == SP.decode(ids)


def test_counts_over_awkward_rows(spark):
    docs = awkward(spark)
    rows = piece_count.token_counts(docs, limit=100).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    assert len(rows) == docs.count()
    for r in rows:
        t = texts[r.doc_id][0]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(SP.encode(t)), len(SP.encode(t)) > 100)
    assert piece_count.token_counts(none(spark)).count() == 0


def test_codec_over_awkward_rows(spark):
    docs = awkward(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = piece_codec.encoded(docs, digests=True).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = SP.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(SP.decode(ids).encode()).hexdigest()
    plain = piece_codec.encoded(docs).collect()
    assert all(list(r.ids) == SP.encode(texts[r.doc_id]) and r.decoded == SP.decode(list(r.ids)) for r in plain)
    assert piece_codec.encoded(none(spark)).count() == 0


def check_packing(docs, rows, capacity):
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(by_doc) == set(texts)
    for doc, ts in texts.items():
        want = []
        for t in ts:
            ids = [*TOK.encode(t, add_special_tokens=False).ids, 0]
            for k, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                want.append((k, at, len(part), zlib.crc32(array("I", part).tobytes())))
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc]) == sorted(want)
    return len(by_seq)


def test_packing_over_awkward_rows(spark):
    docs = awkward(spark)
    check_packing(docs, packing.packed_documents(docs).collect(), 2048)
    assert packing.packed_documents(none(spark)).count() == 0


def test_packing_in_several_rounds_is_near_one_round_over_all(spark):
    rng = random.Random(5)
    rows = [(i, "a " * rng.choice([3, 40, 90, 200, 333, 700]), None, None, 0, None, None, None) for i in range(900)]
    docs = awkward(spark).limit(0).unionByName(spark.createDataFrame(rows, awkward(spark).schema))
    parts = packing.pieces(docs, WORDS, 512)
    placed = packing.pack(parts, 512, group_items=60, fan_in=3).collect()
    n = check_packing(docs, placed, 512)
    at_once = len(packing.best_fit([r.length for r in placed], 512))
    assert n <= 1.02 * at_once + 1


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit([5, 7, 3, 5], 10) == [[1, 2], [0, 3]]
    assert packing.best_fit([], 10) == []


def test_large_items_that_do_not_pair(spark):
    rows = [(i, "a " * 400, None, None, 0, None, None, None) for i in range(300)]
    docs = spark.createDataFrame(rows, awkward(spark).schema)
    placed = packing.pack(packing.pieces(docs, WORDS, 512), 512, group_items=50, fan_in=2).collect()
    assert len({r.sequence_id for r in placed}) == 300


@settings(max_examples=200, deadline=None)
@given(st.integers(4, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c - 1), max_size=80))))
def test_counted_fit_equals_the_fit_of_items(case):
    capacity, sizes = case
    bins, ranks = defaultdict(list), defaultdict(list)
    for size, rank, n, first, at in packing.fit_counts(Counter(sizes), capacity):
        for k in range(n):
            bins[first + k].append((at, size))
            ranks[size].append(rank + k)
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in Counter(sizes).items()}
    for parts in bins.values():
        ends = [at + size for at, size in sorted(parts)]
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= capacity
    plain = sorted(sorted(sizes[i] for i in b) for b in packing.best_fit(sizes, capacity))
    assert sorted(sorted(s for _, s in b) for b in bins.values()) == plain


def test_the_root_merges_what_groups_leave(spark):
    """Bins that never meet in a group: the root still packs them, whatever the number of groups."""
    rng = random.Random(3)
    rows = [(i, 0, 0, rng.choice([150, 170, 200, 260, 300, 340]), i) for i in range(4000)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    at_once = len(packing.best_fit([r[3] for r in rows], 512))
    for options in ({"group_items": 20, "fan_in": 1}, {"group_items": 20, "fan_in": 2}, {"group_pieces": 40, "group_items": 100}):
        placed = packing.pack(parts, 512, **options).collect()
        seqs = defaultdict(list)
        for r in placed:
            seqs[r.sequence_id].append((r.offset, r.length))
        assert sorted(r.doc_id for r in placed) == list(range(4000))
        for s in seqs.values():
            ends = [a + n for a, n in sorted(s)]
            assert [a for a, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 512
        fills = sorted(sum(n for _, n in s) for s in seqs.values())
        assert fills[0] + fills[1] > 512  # no two sequences fit in one
        assert len(seqs) <= 1.08 * at_once  # groups of some 20 to 100 pieces fit worse than all pieces at once

"""Covering, fingerprints, components and near copies against brute force."""

import random
import re

import numpy as np
import xxhash

from taintloom.llm import components, simhash

from .helpers import awkward, none, united


def test_every_close_pair_shares_an_anchor():
    rng = np.random.default_rng(3)
    for bits, most in ((64, 2), (30, 2), (30, 1), (64, 1), (30, 4)):
        n = 200
        x = rng.integers(0, 1 << 62, n, dtype=np.uint64) & np.uint64((1 << bits) - 1)
        y = x.copy()
        for i in range(n):
            for b in rng.choice(bits, int(rng.integers(0, most + 1)), replace=False):
                y[i] ^= np.uint64(1 << int(b))
        (ra, a), (rb, b) = simhash.anchors(x, bits, most), simhash.anchors(y, bits, most)
        for i in range(n):
            assert set(a[ra == i].tolist()) & set(b[rb == i].tolist())
        assert len(a) == len(set(zip(ra.tolist(), a.tolist(), strict=True)))


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h))


def brute(docs):
    rows = sorted({(r.doc_id, r.text) for r in docs if r.doc_id is not None}, key=lambda r: r[0])
    prints = [plain_print(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    roots = united(len(rows), pairs)
    return {rows[i][0]: (f"{prints[i]:016x}", rows[roots[i]][0]) for i in range(len(rows))}


def test_components_equal_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghij") * 3 + rng.choice("xyz") for _ in range(300)) for _ in range(12)]
    rows = []
    for i in range(80):
        words = base[i % 12].split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = "new" + str(rng.randrange(99))
        rows.append((100 + i, " ".join(words), None, None, 0, None, None, None))
    docs = awkward(spark, rows)
    got = simhash.simhash_components(docs).collect()
    want = brute(docs.collect())
    assert len(got) == docs.count()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == want
    assert len({r.component_id for r in got}) < len(got) - 10
    assert simhash.simhash_components(none(spark)).count() == 0


def test_large_cells_lose_nothing(spark):
    rng = np.random.default_rng(1)
    center = int(rng.integers(1 << 62))
    prints = sorted({center ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in (0, 1, 1, 2, 2, 3) for _ in range(40)})
    points = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "node long, fp long")
    edges = simhash.cell_links(simhash.replicated(points, ["fp"], 64, 2), ["fp"], 64, 2, 2, cell_rows=15)
    got = {r.node: r.root for r in components.components(edges).collect()}
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    roots = united(len(prints), pairs)
    assert {i: got.get(i, i) for i in range(len(prints))} == dict(enumerate(roots))
    assert all(bin(prints[r.a] ^ prints[r.b]).count("1") <= 2 for r in edges.collect())


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(200, 260)]
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + chain
    rows = [*pairs, *((b, a) for a, b in pairs[:20]), (5, 5)]
    edges = spark.createDataFrame([*rows, (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    roots = united(261, pairs)
    assert got == {i: roots[i] for p in pairs for i in p if p[0] != p[1]}
    assert components.components(edges.limit(0)).count() == 0


def jaccard(a, b):
    x, y = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies(spark):
    rng = random.Random(4)
    make = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    base = [make(400) for _ in range(15)]
    rows = [(i, t, None, None, 0, None, None, None) for i, t in enumerate(base, 100)]
    for i in range(60):
        words = base[i % 15].split(" ")
        for _ in range(rng.choice([0, 1, 3, 5])):
            words[rng.randrange(len(words))] = "changed"
        rows.append((200 + i, " ".join(words), None, None, 0, None, None, None))
    docs = awkward(spark, rows)
    got = {r.doc_id: r.root for r in simhash.near_copies(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in range(60):
        if jaccard(texts[200 + i], texts[100 + i % 15]) >= 0.8:
            assert got[200 + i] == 100 + i % 15
    assert got[9] == 1 and got[1] == 1
    for d, root in got.items():
        assert d == root or root in texts
    assert not {2, 3, 4, 5, 6, 7, 8} & set(got)
    assert simhash.near_copies(none(spark)).count() == 0


def test_near_copies_lose_no_block_edit(spark):
    rng = random.Random(11)
    make = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(n)]
    rows = []
    for i in range(60):
        words = make(300)
        line = " ".join(words[100:110])
        edited = [" ".join(words + make(72)), " ".join(words + make(60)), " ".join(words) + ("\n" + line) * 12, " ".join(words[:243]), " ".join(make(20) + words[:280])]
        rows += [(10 * i + k, t) for k, t in enumerate([" ".join(words), *edited])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if i // 6 == j // 6 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    roots = united(len(rows), pairs)
    want = {rows[i][0]: rows[roots[i]][0] for p in pairs for i in p}
    assert {r.doc_id: r.root for r in simhash.near_copies(docs).collect()} == want

"""Substring dedup, license scan, toxicity, language ID and the pipeline against brute force and held-out rows."""

import random
import re
import textwrap
from collections import Counter

import numpy as np
import pytest

from taintloom.llm import langcrf, licenses, linededup, toxicity

from .helpers import awkward, none

PASSAGE = " ".join(f"Shared sentence number {k} of the passage stands here." for k in range(8))


def test_repeated_lines_and_passages_go(spark):
    own = "A line of its own that no other document has at all."
    rows = [
        (10, f"First title\n{PASSAGE}\n{own}", None, None, 0, None, None, None),
        (11, f"Other words come first. {PASSAGE} And some follow.\nOf the.", None, None, 0, None, None, None),
        (12, f"  {PASSAGE.upper()}  \nOf the.\nSomething else that stands only in this one.", None, None, 0, None, None, None),
    ]
    docs = awkward(spark, rows)
    got = {r.doc_id: r for r in linededup.deduplicated(docs).collect()}
    assert got[10].text == rows[0][1] and not got[10].removed
    assert got[11].text == "Other words come first. And some follow.\nOf the."
    assert got[12].text == "Something else that stands only in this one."  # the short sentence belongs to the run
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got[9].text == "" and [(s.start, s.end) for s in got[9].removed] == [(0, len(texts[9]))]
    assert got[1].text == texts[1] and got[2].text is None and got[3].text == ""
    for d, r in got.items():
        cut = [texts[d][s.start : s.end] for s in r.removed]
        assert all(re.search(r"Shared sentence|SHARED SENTENCE|cat sat|word", c) for c in cut)
    assert linededup.deduplicated(docs).count() == docs.count()
    assert set(linededup.deduplicated(docs).columns) == set(docs.columns)
    assert linededup.deduplicated(none(spark)).count() == 0


def test_lines_against_brute_force(spark):
    rng = random.Random(6)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(4, 14))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9))), None, None, 0, None, None, None) for i in range(40)]
    docs = spark.createDataFrame(rows, awkward(spark).schema)
    seen, want = set(), {}
    for i, t, *_ in rows:
        keep = []
        for line in t.split("\n"):
            key = " ".join(line.lower().split())
            if len(key.split()) < 6 or key not in seen:
                keep.append(line)
            seen.add(key)
        want[i] = keep
    got = linededup.deduplicated(docs, min_run_words=10_000).collect()
    for r in got:
        assert [x for x in r.text.split("\n") if x] == [x for x in want[r.doc_id] if x]


def plain_scan(text, threshold=0.9):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    words = find(low)
    starts, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    labels = set(base)
    best = 1.0 if starts else 0.0
    for line in low.split("\n"):
        block = set(find(line))
        for label, template in licenses.TEMPLATES:
            t = set(find(template.lower()))
            if len(t & block) >= threshold * len(t) - 1e-9:
                labels.add(label)
                best = max(best, len(t & block) / len(t))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(8)
    vocab = sorted({w for _, t in licenses.TEMPLATES for w in t.split()}) + ["other", "words"]
    rows = []
    for i in range(60):
        label, t = licenses.TEMPLATES[i % len(licenses.TEMPLATES)]
        w = t.split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rng.shuffle(w) if i % 4 == 0 else None
        rows.append((100 + i, "Head é\n" + " ".join(w) + "\nMIT-License mit license, MIT LICENSE apache\nlicense", None, None, 0, None, None, None))
    docs = awkward(spark, rows)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = licenses.license_scan(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == plain_scan(texts[r.doc_id])
    assert licenses.license_scan(none(spark)).count() == 0


def test_license_scan_finds_wrapped_notices(spark):
    rows, want = [], {}
    for i, (label, t) in enumerate(licenses.TEMPLATES):
        for k, (width, lead, between) in enumerate([(72, "", ""), (80, " * ", ""), (30, "# ", "\n")]):
            notice = ("\n" + between).join(lead + x for x in textwrap.wrap(t, width))
            rows.append((10 * i + k, f"Some program\n\nwritten by someone {notice}\nand more text here"))
            want[10 * i + k] = label
    scattered = " ".join(licenses.TEMPLATES[1][1].split()[::2]) + "\n" + "other words here\n" * 40 + " ".join(licenses.TEMPLATES[1][1].split()[1::2])
    rows.append((999, scattered))
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, label in want.items():
        assert label in got[d].labels.split(",") and got[d].score >= 0.9
    assert got[999].labels == "" and got[999].blocks == []


def test_forward_backward_equals_the_plain_sums():
    rng = np.random.default_rng(0)
    for _ in range(15):
        k = int(rng.integers(1, 5))
        lengths = rng.integers(1, 150, size=rng.integers(1, 8))
        e, t = rng.normal(size=(lengths.sum(), k)) * 3, rng.normal(size=(k, k))
        got, at = langcrf.forward_backward(e, lengths, t), 0
        for n in lengths:
            x, w = np.exp(e[at : at + n]), np.exp(t)
            a = [x[0] / x[0].sum()]
            for i in range(1, n):
                a.append((a[-1] @ w) * x[i] / ((a[-1] @ w) * x[i]).sum())
            b = [np.ones(k)]
            for i in range(n - 2, -1, -1):
                b.append(w @ (x[i + 1] * b[-1]) / (w @ (x[i + 1] * b[-1])).sum())
            p = np.array(a) * np.array(b[::-1])
            assert np.allclose(p / p.sum(1, keepdims=True), got[at : at + n])
            at += n


def test_languages_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langcrf.fit(docs)
    got = langcrf.languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    odd = langcrf.languages(awkward(spark), model).collect()
    by = {r.doc_id: r for r in odd}
    assert len(odd) == awkward(spark).count()
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (2, 3, 5, 6))
    assert all(0 <= r.score <= 1 for r in odd)
    assert langcrf.languages(none(spark), model).count() == 0
    assert {r.lang_pred for r in langcrf.languages(docs, None).collect()} == {"und"}
    assert langcrf.fit(none(spark)) is None
    texts = {r.lang: r.text for r in docs.where("lang in ('en', 'de') and n_chars between 600 and 3000").collect()}
    en, de = (" ".join(texts[x].split()[:40]) for x in ("en", "de"))
    spans = langcrf.word_spans(f"{en} {de}", model)
    words = Counter()
    for a, b, lang in spans:
        words[lang, a < len(en)] += len(f"{en} {de}"[a:b].split())
    assert words["en", True] >= 34 and words["de", False] >= 34


def test_toxicity_out_of_sample(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    some = labels.where("doc_id % 3 <> 0")
    chain = toxicity.fit(docs, some)
    got = toxicity.toxicity(docs, chain).join(labels.where("doc_id % 3 = 0").selectExpr("doc_id", "toxic AS y"), "doc_id").collect()
    yes = [r for r in got if r.y == 1]
    assert sum(r.toxic for r in yes) >= 0.6 * len(yes)  # thirty positive examples
    assert sum(r.toxic for r in got if r.y == 0) <= 0.01 * len(got)
    odd = toxicity.toxicity(awkward(spark), chain)
    assert set(awkward(spark).columns) < set(odd.columns) and odd.count() == awkward(spark).count()
    assert not odd.where("toxic").count()
    assert toxicity.toxicity(none(spark), chain).count() == 0
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert {r.p_toxic for r in toxicity.toxicity(docs.limit(5), None).collect()} == {0.0}


def test_pipeline_stages(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= {r.doc_id for r in docs.select("doc_id").collect()}
        assert len(kept) >= 0.7 * n
        docs = out.cache()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_the_chain_equals_plain_sums(spark, sf):
    """Every probability by plain loops over words and features; the last link decides."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels)
    if chain is None:
        pytest.skip("one class only")
    chosen = {int(v): k for k, v in enumerate(chain.lexicon.chosen)}
    for r in toxicity.toxicity(docs, chain).limit(60).collect():
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        hits = {w: {chosen[g] for g in toxicity.grams(w).tolist() if g in chosen} for w in set(words)}
        counted = Counter(w for w in words if hits[w])
        n = sum(min(c, chain.repeats) for c in counted.values())
        dense = [np.log1p(n), np.log1p(len(counted)), 30 * n / max(len(words), 30)]
        features, before = set().union(*(hits[w] for w in counted)) if counted else set(), []
        for w in chain.weights:
            z = sum(w[f] for f in features) + sum(a * b for a, b in zip([*dense, *before, 1.0], w[len(chosen) :], strict=True))
            before.append(1 / (1 + np.exp(-max(-30, min(30, z)))) if words else 0.0)
        assert np.allclose([r.p_toxic_dense, r.p_toxic_repeated, r.p_toxic], before)
        assert r.toxic == (before[-1] >= 0.5)


def test_the_gradient_of_the_chain_field_is_that_of_the_likelihood():
    rng = np.random.default_rng(4)
    emit, t = rng.normal(size=(2, 5, 3)), rng.normal(size=(3, 3))
    gold = rng.integers(0, 3, (2, 5))

    def likelihood(e, w):
        total = 0.0
        for k in range(2):
            score = lambda y, k=k: sum(e[k, i, y[i]] for i in range(5)) + sum(w[y[i], y[i + 1]] for i in range(4))
            every = [score(y) for y in np.ndindex(3, 3, 3, 3, 3)]
            total += score(gold[k]) - np.log(np.exp(every).sum())
        return total

    p, pair = langcrf._expected(emit, t)
    seen = np.zeros((3, 3))
    np.add.at(seen, (gold[:, :-1].reshape(-1), gold[:, 1:].reshape(-1)), 1)
    for at in ((0, 0, 1), (1, 4, 2), (0, 2, 0)):
        d = np.zeros_like(emit)
        d[at] = 1e-5
        slope = (likelihood(emit + d, t) - likelihood(emit - d, t)) / 2e-5
        assert abs(slope - ((gold[at[0], at[1]] == at[2]) - p[at])) < 1e-6
    for at in ((0, 1), (2, 2)):
        d = np.zeros_like(t)
        d[at] = 1e-5
        assert abs((likelihood(emit, t + d) - likelihood(emit, t - d)) / 2e-5 - (seen[at] - pair[at])) < 1e-6


def test_a_hot_line_and_many_others(spark):
    """A line that all documents share is cut from all but the first, as by brute force, whatever tasks it lies in."""
    hot = "this very common line stands in every document"
    rows = [(i, f"{hot}\nthe own line of document {i} stands here\n{hot}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.text, len(r.removed)) for r in linededup.deduplicated(docs).collect()}
    assert got[0] == (f"{hot}\nthe own line of document 0 stands here\n", 1)
    assert all(got[i] == (f"the own line of document {i} stands here\n", 2) for i in range(1, 400))

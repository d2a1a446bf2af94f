"""Operator 7, license scans: phrases, and an exact set-similarity join of text blocks with license templates.

Tokens are ordered by their frequency over all blocks of the corpus, rare ones first. A block that holds at least
a = ceil(threshold * |T|) of a template's |T| distinct tokens holds one of the first |T| - a + 1 of them (prefix filter),
has a tokens or more (length filter), and from the first shared token on either side has enough tokens left (positional
filter). What passes is verified, so the join finds exactly the blocks that meet the threshold.

Blocks are lines and, for notices that are wrapped, runs of words across lines (blank ones too). Such a run has at most
1 / threshold words for each of the template's, so that tokens scattered over a document make no notice; a document has
to pass the join as one block before its runs are looked at. Words that stand before every line count as words.
"""

from __future__ import annotations

import math
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public license notices by label.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
]

#: A-Z to lower case; every other byte that is in no word to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def block_words(text: str) -> list[list[bytes]]:
    """Words of every block (line) of the whole text, in order; a newline is in no word, so none goes across blocks."""
    return [line.translate(_FOLD).split() for line in text.encode().split(b"\n")]


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> tuple[int, int | None, int | None, set[str]]:
    """(places, smallest start, largest start, labels) of the phrases in a sequence of words."""
    joined = b" " + b" ".join(words) + b" "
    n, first, last, labels = 0, None, None, set()
    for phrase, label in phrases.items():
        want = b" " + phrase.encode() + b" "
        at, word, counted = joined.find(want), 0, 0
        while at >= 0:
            word += joined.count(b" ", counted, at)
            counted = at
            n += 1
            labels.add(label)
            first = word if first is None else min(first, word)
            last = word if last is None else max(last, word)
            at = joined.find(want, at + 1)
    return n, first, last, labels


class TemplateIndex:
    """Templates with their tokens in the corpus' order, and the inverted index of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float) -> None:
        self.templates, self.prefix = [], {}
        for label, text in templates:
            words = [w for ws in block_words(text) for w in ws]
            tokens = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
            need = math.ceil(threshold * len(tokens) - 1e-9)
            self.templates.append((label, frozenset(tokens), need, math.floor(len(words) / threshold + 1e-9)))
            for p, w in enumerate(tokens[: len(tokens) - need + 1]):
                self.prefix.setdefault(w, []).append((len(self.templates) - 1, p))
        self.vocabulary = frozenset().union(*(t[1] for t in self.templates))
        self.starts = frozenset(self.prefix)
        self.order = {w: k for k, w in enumerate(sorted(self.vocabulary, key=lambda w: (frequency.get(w, 0), w)))}

    def matches(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of every template that the block meets the threshold of."""
        if self.starts.isdisjoint(words):
            return []
        block = sorted(self.vocabulary.intersection(words), key=self.order.__getitem__)
        seen: dict[int, bool] = {}
        for q, w in enumerate(block):
            for t, p in self.prefix.get(w, ()):
                if t not in seen:  # the first shared token decides: all that can still be shared stands behind it
                    _, tokens, need, _ = self.templates[t]
                    seen[t] = len(block) >= need and min(len(tokens) - p, len(block) - q) >= need
        out = []
        for t, possible in seen.items():
            _, tokens, need, _ = self.templates[t]
            if possible and (shared := len(tokens.intersection(block))) >= need:
                out.append((t, shared / len(tokens)))
        return out

    def wrapped(self, lines: list[list[bytes]], template: int, met: set[int]) -> list[tuple[int, float]]:
        """(first line, containment) of runs of words across lines that meet the template, none with a word of another or
        of the lines in `met`, which do so by themselves."""
        _, tokens, need, most = self.templates[template]
        out: list[tuple[int, float]] = []
        run: deque[tuple[int, int, bytes]] = deque()
        held: Counter = Counter()
        best, end, place = (0, 0), 0, 0

        def leave():
            if best[0]:
                out.append((best[1], best[0] / len(tokens)))
            run.clear()
            held.clear()

        for k, words in enumerate(lines):
            if k in met:
                leave()
                best = (0, 0)
                place += len(words)
                continue
            for w in words:
                if best[0] and place >= end:
                    leave()
                    best = (0, 0)
                if w in tokens:
                    run.append((place, k, w))
                    held[w] += 1
                    while run[0][0] <= place - most:
                        gone = run.popleft()[2]
                        held[gone] -= 1
                        if not held[gone]:
                            del held[gone]
                    if len(held) >= need and len(held) > best[0]:
                        end = end if best[0] else run[0][0] + most
                        best = (len(held), run[0][1])
                place += 1
        leave()
        return out

    def blocks(self, lines: list[list[bytes]]) -> list[tuple[int, str, float]]:
        """(first line, label, containment) of every line and run of words across lines that meets a template."""
        found = [(k, t, share) for k, ws in enumerate(lines) for t, share in self.matches(ws)]
        if len(lines) > 1:
            for t, _ in self.matches([w for ws in lines for w in ws]):
                met = {k for k, other, _ in found if other == t}
                found += [(k, t, share) for k, share in self.wrapped(lines, t, met)]
            found.sort(key=lambda f: f[0])
        return [(k, self.templates[t][0], share) for k, t, share in found]


def token_frequencies(docs: DataFrame, templates: list[tuple[str, str]], text: str = "text") -> dict[bytes, int]:
    """In how many blocks of all documents each template token stands: a bounded table, summed per task first."""
    wanted = frozenset(w for _, t in templates for ws in block_words(t) for w in ws)

    def run(batches):
        n: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                for ws in block_words(t or ""):
                    n.update(wanted.intersection(ws))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["token", "n"])

    counted = docs.select(F.col(text)).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r["token"]): r["n"] for r in counted.collect()}


def license_scan(docs: DataFrame, threshold: float = 0.9, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: (key, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks).

    `blocks`: array<struct<block:int,label:string,containment:double>> of every line, or run of words across lines (by
    the line that it begins in), that meets a template. `score` is the
    largest containment found, 1 where a phrase stands, else 0. Null and empty texts have no words, empty labels, null
    first_word and last_word. Repeated rows and null keys each give their own row; other columns are not read; an empty
    table gives an empty result. Two passes over the text (frequencies, then the join), no shuffle of it.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    small_batches(docs.sparkSession)
    index = TemplateIndex(templates, token_frequencies(docs, templates, text), threshold)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows: tuple[list, ...] = tuple([] for _ in range(8))
            for t in b.column(1).to_pylist():
                lines = block_words(t or "")
                words = [w for ws in lines for w in ws]
                n, first, last, base = phrase_places(words, phrases)
                found = index.blocks(lines)
                score = max([1.0 if n else 0.0, *(f[2] for f in found)])
                labels = sorted(base | {f[1] for f in found})
                blocks = [{"block": k, "label": label, "containment": share} for k, label, share in found]
                for column, value in zip(rows, (len(words), n, first, last, ",".join(sorted(base)), ",".join(labels), score, blocks), strict=True):
                    column.append(value)
            block = pa.list_(pa.struct([("block", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), block]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names=[key, *names])

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
    schema = f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<block:int,label:string,containment:double>>"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)

"""License scans by an exact set-similarity join of templates with blocks of text.

A template is the set of its words. A block is any run of as many words as the template has, and a quarter more, so that a
few inserted words do no harm; it contains the template at ``share`` or more if it has that share of the template's distinct
words. Template words are ordered by how often they stand in all documents, rarest first (counted by one pass with sums a
task). A block that contains enough of a template must have one of the first ``size - need + 1`` words of that order (prefix
filter), ``need`` template words at all (length filter), and room for the rest of them after the rarest one that it has
(positional filter). The inverted index of these prefixes is what tasks hold; what passes is verified by counting distinct
words. Every start at a template word is tried, so that no block that meets the share is missed. Templates are a stated list
(``most_templates`` bounds it); documents stay where they are read and are never shuffled.

Beside the templates there are phrases: words that stand consecutively, found anywhere.

Defined results: null and empty texts have no words and no label. Very long texts are scanned whole, in time that grows with
the text. Ties: of equally good blocks of a label the first counts. Repeated rows are each reported for themselves; an empty
table gives no rows; without templates only phrases are found. A template without words is an error. Only id and text are
read, whatever other columns are named.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import map_batches, read

#: Separators become spaces and A-Z lower case; bytes of longer characters stay.
_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))

#: The phrases of the contract and their labels.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: The notices by which public licenses ask to be named.
TEMPLATES = [
    ("agpl", "GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Released under the BSD License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
SHARE = (9, 10)
SCHEMA = "n_words long, phrases array<struct<label:string,n:long,first:long,last:long>>, blocks array<struct<label:string,start:long,end:long,score:double>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Templates:
    """The prefix index of the templates, in the words' order of ``counts``."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], share: tuple[int, int]):
        self.labels, self.sizes, self.needs, self.widths, self.tokens = [], [], [], [], []
        self.prefix: dict[bytes, list[int]] = {}
        self.known: dict[bytes, int] = {}
        for i, (label, text) in enumerate(templates):
            ws = words(text)
            if not ws:
                raise ValueError(f"the template of {label} has no words")
            order = sorted(set(ws), key=lambda w: (counts.get(w, 0), w))
            need = -(-share[0] * len(order) // share[1])
            self.labels.append(label)
            self.sizes.append(len(order))
            self.needs.append(need)
            self.widths.append(-(-5 * len(ws) // 4))
            self.tokens.append({w: rank for rank, w in enumerate(order)})
            for w in order[: len(order) - need + 1]:
                self.prefix.setdefault(w, []).append(i)

    def blocks(self, ws: list[bytes]) -> list[tuple[str, int, int, float]]:
        """``label, start, end, score`` of each run of overlapping blocks that meet the share, by their best one's score."""
        at: dict[int, list[int]] = {}
        for w in self.prefix.keys() & set(ws):
            for t in self.prefix[w]:
                at.setdefault(t, [])
        if not at:
            return []
        places: dict[bytes, list[int]] = {}
        wanted = set().union(*(self.tokens[t] for t in at))
        for p, w in enumerate(ws):
            if w in wanted:
                places.setdefault(w, []).append(p)
        out = []
        for t in sorted(at):
            if sum(w in places for w in self.tokens[t]) >= self.needs[t]:
                out += self._of(t, places)
        return sorted(out, key=lambda b: (b[1], b[0], b[2]))

    def _of(self, t: int, places: dict[bytes, list[int]]) -> list[tuple[str, int, int, float]]:
        ranks, need, width, size = self.tokens[t], self.needs[t], self.widths[t], self.sizes[t]
        found = sorted((p, r) for w, r in ranks.items() for p in places.get(w, ()))
        pos = np.array([p for p, _ in found])
        rank = np.array([r for _, r in found])
        ends = np.searchsorted(pos, pos + width)
        rare = np.concatenate([[0], np.cumsum(rank <= size - need)])
        starts = np.flatnonzero((ends - np.arange(len(pos)) >= need) & (rare[ends] > rare[:-1]))  # length and prefix filters
        runs: list[list] = []
        for k in starts.tolist():
            part = rank[k : ends[k]]
            least = int(part.min())
            if min(size - least, 1 + int((part > least).sum())) < need:  # positional filter
                continue
            n = len(set(part.tolist()))
            if n >= need:
                start, end = int(pos[k]), int(pos[ends[k] - 1]) + 1
                if runs and start < runs[-1][1]:
                    runs[-1][1:] = [max(end, runs[-1][1]), max(n, runs[-1][2])]
                else:
                    runs.append([start, end, n])
        return [(self.labels[t], a, b, n / size) for a, b, n in runs]


def phrase_places(ws: list[bytes], phrases: list[tuple[str, list[bytes]]]) -> list[tuple[str, int, int, int]]:
    """``label, n, first, last`` of each phrase that ``ws`` has."""
    out, have = [], set(ws)
    for label, phrase in phrases:
        if not have.issuperset(phrase):
            continue
        at, last = [], len(ws) - len(phrase)
        p = -1
        while True:
            try:
                p = ws.index(phrase[0], p + 1)
            except ValueError:
                break
            if p <= last and ws[p : p + len(phrase)] == phrase:
                at.append(p)
        if at:
            out.append((label, len(at), at[0], at[-1]))
    return out


def frequencies(docs: DataFrame, text: str, known: set[bytes]) -> dict[bytes, int]:
    """How often each of the ``known`` words stands in all texts."""

    def counter():
        def run(batch: pa.RecordBatch):
            n: Counter = Counter()
            for t in batch.column(0).to_pylist():
                n.update(filter(known.__contains__, words(t)))
            return [list(n), list(n.values())] if n else None

        return run

    counts = map_batches(docs.select(F.col(text).alias("_t")), counter, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {bytes(r["w"]): r["n"] for r in counts.collect()}  # no more rows than known words


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None, text: str = "text", key: str = "doc_id", share: tuple[int, int] = SHARE, most_templates: int = 10_000) -> DataFrame:
    """``key`` and the columns of SCHEMA, a row a document: the phrases' places, and the blocks that contain a template."""
    templates = TEMPLATES if templates is None else templates
    if len(templates) > most_templates:
        raise ValueError(f"over {most_templates} templates")
    listed = [(label, words(p)) for label, p in (PHRASES if phrases is None else phrases)]
    index = Templates(templates, frequencies(docs, text, {w for _, t in templates for w in words(t)}), share)
    kind = docs.schema[key].dataType.simpleString()

    def scanner():
        def run(batch: pa.RecordBatch):
            n, found, blocks = [], [], []
            for t in batch.column(1).to_pylist():
                ws = words(t)
                n.append(len(ws))
                found.append([dict(zip(("label", "n", "first", "last"), p, strict=True)) for p in phrase_places(ws, listed)])
                blocks.append([dict(zip(("label", "start", "end", "score"), b, strict=True)) for b in index.blocks(ws)])
            return [batch.column(0), n, found, blocks]

        return run

    return map_batches(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), scanner, f"_k {kind}, {SCHEMA}").withColumnRenamed("_k", key)


def op11(spark, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    p, b = F.col("phrases"), F.col("blocks")
    n = F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    base, own = F.transform(p, lambda x: x["label"]), F.transform(b, lambda x: x["label"])
    label = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    score = F.when(F.size(p) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(b, lambda x: x["score"])), F.lit(0.0)))
    first, last = F.array_min(F.transform(p, lambda x: x["first"])), F.array_max(F.transform(p, lambda x: x["last"]))
    return found.select("doc_id", "n_words", n.alias("n_base"), first.alias("first_word"), last.alias("last_word"), label(base).alias("base_labels"), label(F.concat(base, own)).alias("labels"), score.alias("score"), F.size(b).cast("long").alias("n_blocks"))


def _values(pairs: list[tuple[str, str]]) -> str:
    return ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(pairs))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
t AS (SELECT i, label, {_WORDS} AS ws FROM (VALUES {_values(TEMPLATES)}) v(i, label, text)),
tok AS (SELECT DISTINCT i, unnest(ws) AS w FROM t),
tt AS (SELECT t.i, label, count(*) AS size, ceil(count(*) * {SHARE[0]} / {SHARE[1]}.0) AS need, ceil(5 * any_value(len(ws)) / 4.0) AS width FROM t JOIN tok USING (i) GROUP BY ALL),
p AS (SELECT i, label, {_WORDS} AS ws FROM (VALUES {_values(PHRASES)}) v(i, label, text)),
o AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS j FROM d),
b AS (SELECT r, label, o.j FROM o JOIN p ON o.w = p.ws[1] JOIN d USING (r) WHERE list_slice(d.ws, j + 1, j + len(p.ws)) = p.ws),
bs AS (SELECT r, count(*) AS n, min(j) AS a, max(j) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM b GROUP BY r),
x AS (SELECT r, i, j, w FROM o JOIN tok USING (w)),
enough AS (SELECT r, i FROM x JOIN tt USING (i) GROUP BY r, i HAVING count(DISTINCT w) >= any_value(need)),
y AS (SELECT x.* FROM x JOIN enough USING (r, i)),
runs AS (SELECT s.r, s.i, s.j, count(DISTINCT e.w) AS n, max(e.j) + 1 AS z FROM y s JOIN tt USING (i) JOIN y e ON e.r = s.r AND e.i = s.i AND e.j >= s.j AND e.j < s.j + tt.width GROUP BY ALL),
met AS (SELECT r, i, label, j, z, n / size AS score, max(z) OVER (PARTITION BY r, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs JOIN tt USING (i) WHERE n >= need),
ms AS (SELECT r, max(score) AS score, count(*) FILTER (before IS NULL OR j >= before) AS n_blocks FROM met GROUP BY r),
ls AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM met) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(bs.n, 0) AS n_base, bs.a AS first_word, bs.z AS last_word, coalesce(bs.ls, '') AS base_labels, coalesce(ls.ls, '') AS labels,
  CASE WHEN bs.n > 0 THEN 1.0 ELSE coalesce(ms.score, 0) END::DOUBLE AS score, coalesce(ms.n_blocks, 0) AS n_blocks
FROM d LEFT JOIN bs USING (r) LEFT JOIN ls USING (r) LEFT JOIN ms USING (r)
"""

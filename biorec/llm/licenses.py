"""Licence scans: TF-IDF cosines to templates, then inheritance from the nearest ancestor directory.

Header candidates of a text are its lines and sentences that hold a licence term, and every run of
words of a statement's length that holds one, across line breaks and within paragraphs; the
sparse TF-IDF vector of each is compared with the statements' by cosine. Runs are bounded from
above first (repeated words can only lower a cosine), and exact cosines are computed while a bound
reaches the best so far. Document frequencies of the statements' terms are counted over all
files; a word that no statement holds weighs as one that no file holds. "All rights reserved"
also stands beside other licences, so it counts only where no other statement matches.

Full licence texts are templates of their own (``license_texts``). A text covers one by the share of
its distinct runs of three words. A text is a licence file if it covers a full text by ``COVERED``
and at least ``MOSTLY`` of its words lie in runs of full texts (a source file under a whole licence
header isn't one), or if the whole of it is close to a statement. A covered full text goes before
statements in the text, whether or not the text is a licence file; its score is the covered share.

A file without a licence of its own takes that of the nearest ancestor directory with a licence
file. Each distinct directory of such files is joined once, by the paths of its ancestors, with the
directories of licence files, and then with its files. Of several licence files in one directory
the closest match counts, ties by name.

A file with null text or no match has licence null and how ``none``; a null path has no
directories. Repeated rows are judged alike. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biorec.llm.common import materialize

LEAST = 0.6
COVERED, MOSTLY = 0.75, 0.5
# Statements that stand for each licence.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See the license file in the project root."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("LGPL", "Licensed under the GNU Lesser General Public License."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD", "Use of this source code is governed by a BSD style license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has waived all copyright under CC0 1.0 public domain dedication."),
    ("proprietary", "All rights reserved."),
)
_WORD = re.compile(r"[^\W_]+")
_TRIGGER = re.compile(r"(?i)licen[sc]e|copyright|rights\W+reserved|redistribut|public\W+domain|permission|\bCC\b|\bGNU\b")
_TRIGGER_WORD = re.compile(r"licen[sc]e|copyright|redistribut|permission|^cc$|^gnu$")
_TRIGGER_PAIRS = (("rights", "reserved"), ("public", "domain"))
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n\s*\n")


def terms(text: str) -> Counter:
    return Counter(w.lower() for w in _WORD.findall(text))


VOCABULARY = frozenset(w for _, t in TEMPLATES for w in terms(t))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, counts = 0, Counter()
    for batch in batches:
        for t in batch.column("text"):
            n += 1
            if t := t.as_py():
                counts.update(VOCABULARY.intersection(_WORD.findall(t.lower())))
    keys = ["", *counts]
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n, *(counts[k] for k in keys[1:])], pa.int64())], ["term", "n"])


def full_texts() -> list[tuple[str, str]]:
    """(licence, full text), from the package's files."""
    files = sorted((f for f in resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    known = sorted({name for name, _ in TEMPLATES}, key=len, reverse=True)
    return [(next(n for n in known if f.name.startswith(n + ".")), f.read_text(encoding="utf-8")) for f in files]


def _rank(found: tuple[float, str]) -> tuple:
    """Matches go before others, "proprietary" last among them; then the larger score, ties by name."""
    score, name = found
    return score >= LEAST and name != "proprietary", round(score, 9), name


class Matcher:
    """Built on the driver; holds all that a scan needs."""

    def __init__(self, counts: dict[str, int]):
        files = counts.get("", 0)
        self.idf = {w: math.log((1 + files) / (1 + counts.get(w, 0))) + 1 for w in VOCABULARY}
        self.other = math.log(1 + files) + 1
        self.templates = [(name, *self.vector(terms(t))) for name, t in TEMPLATES]
        # By word of the statements (the last row: any other word): its part of each dot product, and its squared weight.
        self.place = {w: i for i, w in enumerate(sorted(VOCABULARY))}
        weight = np.array([*(self.idf[w] for w in self.place), self.other])
        self.lengths = [sum(terms(t).values()) for _, t in TEMPLATES]
        self.parts = np.array([[t.get(w, 0.0) for w in self.place] + [0.0] for _, t, _ in self.templates]).T * weight[:, None]
        self.squares = weight * weight

        full = [(name, [w.lower() for w in _WORD.findall(t)]) for name, t in full_texts()]
        self.full_place = {w: i for i, w in enumerate(sorted({w for _, words in full for w in words}))}
        self.full = [(name, np.unique(self.triples(words))) for name, words in full]
        self.any_full = np.unique(np.concatenate([x for _, x in self.full]))
        self.least_full = COVERED * min(len(x) for _, x in self.full)

    def vector(self, tf: Counter) -> tuple[dict[str, float], float]:
        v = {w: n * self.idf.get(w, self.other) for w, n in tf.items()}
        return v, math.sqrt(sum(x * x for x in v.values()))

    def best(self, text: str) -> tuple[float, str]:
        """The best cosine and its licence, by ``_rank``."""
        v, size = self.vector(terms(text))
        return max((((sum(x * v.get(w, 0.0) for w, x in t.items()) / (norm * size)), name) for name, t, norm in self.templates), key=_rank) if size else (0.0, "")

    def triples(self, words: list[str]) -> np.ndarray:
        """A number for each run of three words; -1 where a word stands in no full text."""
        x = np.array([self.full_place.get(w, -1) for w in words], np.int64)
        if len(x) < 3:
            return np.zeros(0, np.int64)
        a, b, c, n = x[:-2], x[1:-1], x[2:], len(self.full_place)
        return np.where((a < 0) | (b < 0) | (c < 0), -1, (a * n + b) * n + c)

    def covered(self, words: list[str]) -> tuple[float, str, bool]:
        """The most covered full text (ties by name) and whether the text is mostly full texts; (0, "", False) under COVERED."""
        own = self.triples(words)
        inside = np.isin(own, self.any_full)
        distinct = np.unique(own[inside])
        if len(distinct) < self.least_full:
            return 0.0, "", False
        share, name = max((np.isin(x, distinct).mean(), name) for name, x in self.full)
        if share < COVERED:
            return 0.0, "", False
        held = np.zeros(len(words), bool)
        for k in range(3):
            held[k : len(own) + k] |= inside
        return float(share), name, bool(held.mean() >= MOSTLY)

    def best_run(self, words: list[str], best: tuple[float, str]) -> tuple[float, str]:
        """The best of ``best`` and all runs of a statement's length that hold a licence term."""
        hot_words = {w for w in set(words) if _TRIGGER_WORD.search(w)}
        hot = np.array([w in hot_words or pair in _TRIGGER_PAIRS for w, pair in zip(words, zip(words, [*words[1:], ""]))])
        places = np.flatnonzero(hot)
        if not len(places):
            return best
        # Stretches of words that such runs can reach.
        reach = max(self.lengths)
        for group in np.split(places, np.flatnonzero(np.diff(places) > 2 * reach) + 1):
            lo, hi = max(0, int(group[0]) - reach), int(group[-1]) + reach + 1
            best = self._best_run(words[lo:hi], hot[lo:hi], best)
        return best

    def _best_run(self, words: list[str], hot: np.ndarray, best: tuple[float, str]) -> tuple[float, str]:
        x = np.array([self.place.get(w, len(self.place)) for w in words])
        sums = lambda v: np.concatenate([np.zeros((1, *v.shape[1:])), np.cumsum(v, axis=0)])
        dots, squares, hots = sums(self.parts[x]), sums(self.squares[x]), sums(hot.astype(np.float64))
        for k, ((name, t, norm), n) in enumerate(zip(self.templates, self.lengths)):
            if n > len(words):
                continue
            bound = (dots[n:, k] - dots[:-n, k]) / (norm * np.sqrt(squares[n:] - squares[:-n])) + 1e-9
            bound[hots[n:] - hots[:-n] < 0.5] = -1
            for i in np.argsort(-bound, kind="stable"):
                if bound[i] <= 0 or _rank((bound[i], name)) <= _rank(best):
                    break
                v, size = self.vector(Counter(words[i : i + n]))
                best = max(best, (sum(y * v.get(w, 0.0) for w, y in t.items()) / (norm * size), name), key=_rank)
        return best


def _scan(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = shared.value
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                text = t.as_py() or ""
                best, whole = (0.0, ""), False
                if _TRIGGER.search(text):
                    words = [w.lower() for w in _WORD.findall(text)]
                    near = {x for x in (*text.split("\n"), *_SENTENCE_END.split(text)) if _TRIGGER.search(x)}
                    best = match.best_run(words, max(map(match.best, near), key=_rank, default=best))
                    if (full := match.best(text))[0] >= LEAST:
                        best, whole = max(best, full, key=_rank), True
                    share, name, mostly = match.covered(words)
                    if share:
                        best, whole = (share, name), whole or mostly
                rows.append((best[1], best[0], whole) if best[0] >= LEAST else (None, best[0], False))
            name, score, whole = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["id", "path"]).columns, pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(whole, pa.bool_())], ["id", "path", "license", "score", "is_license_file"]
            )

    return scan


def scan_licenses(files: DataFrame) -> DataFrame:
    """One row per row of ``files(id, path, text)``: id, path, license, how (own, inherited, none), score."""
    spark = files.sparkSession
    counted = files.select("text").mapInArrow(_frequencies, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    match = Matcher({r["term"]: r["n"] for r in counted.collect()})  # at most one row for each template term
    found = materialize(files.select("id", "path", "text").mapInArrow(_scan(spark.sparkContext.broadcast(match)), "id long, path string, license string, score double, is_license_file boolean"), "licenses")

    directory = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    owners = found.where("is_license_file and path is not null").groupBy(directory.alias("dir")).agg(F.max_by(F.struct("license", "score"), F.struct("score", "license")).alias("from"))
    parts = F.when(F.col("own_dir") == "", F.array().cast("array<string>")).otherwise(F.split("own_dir", "/"))
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("dir")))
    asking = found.where("license is null and path is not null").select(directory.alias("own_dir")).distinct().select("own_dir", F.explode(above).alias("a")).select("own_dir", "a.*")
    nearest = asking.join(owners, "dir").groupBy("own_dir").agg(F.max_by("from", "depth").alias("from"))
    joined = found.withColumn("own_dir", F.when(F.col("license").isNull(), directory)).join(nearest, "own_dir", "left")
    how = F.when(F.col("license").isNotNull(), "own").when(F.col("from").isNotNull(), "inherited").otherwise("none")
    return joined.select("id", "path", F.coalesce("license", "from.license").alias("license"), how.alias("how"), F.when(F.col("license").isNull() & F.col("from").isNotNull(), F.col("from.score")).otherwise(F.col("score")).alias("score"))

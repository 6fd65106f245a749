"""Language identification by string kernels.

Documents are sets of byte n-grams (n = 1 to 4, blended spectrum, presence only, lower-cased),
hashed to ``DIM`` places. The kernel of two documents is the number of shared places over the
geometric mean of their numbers of places. ``LANDMARKS`` documents of the training sample give the
Nystrom features K(x, L) K(L, L)^-1/2; one-versus-rest kernel ridge regression on these gives a
score for each language. All documents are scored by batched matrix products, over whole texts.

Training rows: at most about ``PER_LANG`` documents of each language and ``SAMPLE`` in all, drawn by
a hash of id and text from rows with a non-null lang outside the held-out fold. Their place sets
(``DIM`` bits each), not their texts, reach the driver, equal ones of a language once. Any number of
languages may occur: with more of them fewer documents of each are drawn, and with more than
``SAMPLE`` some are not learnt. Any number of rows or length of text is scored; a null text or one
without a letter is ``und`` with score 0. With no training rows every prediction is ``und``.
Repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biorec.llm.common import doc_key, fold, slices, utf8

DIM = 1 << 13
GRAMS = 4
PER_LANG, LANDMARKS = 400, 256
RIDGE = 1e-3
SAMPLE = 20_000
#: Up to so many languages their counts stand in the plan; more are joined as a table.
IN_PLAN = 2000
HELD_OUT = 2
_LETTER = regex.compile(r"\p{L}")


def presence(data: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
    """Mark the places of each row's n-grams in the rows of ``out``."""
    first, last = int(offsets[0]), int(offsets[-1])
    b = data[first:last].astype(np.uint32)
    if not len(b):
        return
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets)) * DIM
    flat = out.reshape(-1)
    h = np.zeros(len(b), np.uint32)
    for n in range(1, GRAMS + 1):
        size = len(b) - n + 1
        if size <= 0:
            return
        h = h[:size] * np.uint32(257) + b[n - 1 :] + np.uint32(n)
        whole = row[:size] == row[n - 1 :]
        place = (h * np.uint32(2654435769)) >> np.uint32(32 - DIM.bit_length() + 1)
        flat[(row[:size] + place)[whole]] = 1


def _letters(texts: pa.Array) -> np.ndarray:
    return np.array([bool(t) and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)


def _rows(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row ranges of at most 256 rows with their places as 0 and 1."""
    data, offsets = utf8(texts)
    for i, j in slices(offsets):
        for k in range(i, j, 256):
            end = min(j, k + 256)
            x = np.zeros((end - k, DIM), np.float32)
            presence(data, offsets[k : end + 1], x)
            yield k, end, x


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [row.tobytes() for _, _, x in _rows(batch.column("low")) for row in np.packbits(x.astype(np.uint8), axis=1)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("lang"), pa.array(bits, pa.binary())], ["key", "lang", "bits"])


class Model:
    """Landmarks, no more than asked for, and for each language as many weights."""

    def __init__(self, langs: list[str], landmarks: np.ndarray, weights: np.ndarray, least: np.ndarray):
        self.langs, self.weights = langs, weights
        self.landmarks, self.sizes = np.ascontiguousarray(landmarks.T), least

    def scores(self, x: np.ndarray) -> np.ndarray:
        k = x @ self.landmarks / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] / self.sizes
        return k @ self.weights


def _drawn(known: DataFrame, per_lang: int, sample: int, in_plan: int, seed: str) -> DataFrame:
    """About ``per_lang`` rows of each language and ``sample`` in all: (lang, text, key)."""
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    got = counts.limit(in_plan + 1).collect()
    langs = len(got) if len(got) <= in_plan else counts.count()
    least = max(1, min(per_lang, sample // max(1, langs)))
    key = F.md5(F.concat_ws(":", F.lit(seed), doc_key(), F.md5(F.col("text").cast("binary"))))
    draw = F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / float(1 << 52)
    share = F.lit(least * min(1.0, sample / max(1, langs))) / F.col("n")
    if langs <= in_plan:
        # The counts go into the plan, so no text is shuffled by its language.
        pairs = [F.lit(x) for r in got for x in (r["lang"], r["n"])]
        counted = known.withColumn("n", F.element_at(F.create_map(*pairs), F.col("lang"))) if pairs else known.withColumn("n", F.lit(1))
    else:
        counted = known.join(counts, "lang")
    return counted.where(draw < share).select("lang", "text", key.alias("key"))


def fit(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS, seed: str = "lang", sample: int = SAMPLE, in_plan: int = IN_PLAN) -> Model | None:
    """Learn from rows outside the held-out fold; None if there are none."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != HELD_OUT)).select("doc_id", "lang", "text")
    picked = _drawn(known, per_lang, sample, in_plan, seed)
    packed = picked.select("key", "lang", F.lower("text").alias("low")).mapInArrow(_packed, "key string, lang string, bits binary")
    rows = packed.groupBy("lang", "bits").agg(F.min("key").alias("key")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["key"], r["lang"], r["bits"]))
    langs = sorted({r["lang"] for r in rows})
    bits = np.array([np.frombuffer(r["bits"], np.uint8) for r in rows])
    unpacked = lambda which: np.unpackbits(bits[which], axis=1).astype(np.float32)
    y = np.array([[1.0 if r["lang"] == c else -1.0 for c in langs] for r in rows])
    # Landmarks are dealt out over the languages in turn, and there are no more than asked for.
    by = [[i for i, r in enumerate(rows) if r["lang"] == c] for c in langs]
    own = max(1, landmarks // len(langs))
    turns = sorted((turn, i) for group in by for turn, i in enumerate(group[:own]))
    at = sorted(i for _, i in turns[:landmarks])
    size = np.sqrt(np.maximum(np.bitwise_count(bits).sum(axis=1, dtype=np.int64), 1)).astype(np.float32)
    marks = unpacked(at)
    dots = np.concatenate([unpacked(slice(k, k + 1024)) @ marks.T for k in range(0, len(rows), 1024)])
    k = (dots / size[:, None] / size[at]).astype(np.float64)
    values, vectors = np.linalg.eigh(k[at])
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = k @ root
    weight = np.array([1 / max(1, len(by[c])) for c in y.argmax(axis=1)])[:, None]
    w = np.linalg.solve(z.T @ (weight * z) + RIDGE * np.eye(z.shape[1]), z.T @ (weight * y))
    return Model(langs, marks, (root @ w).astype(np.float32), size[at].astype(np.float32))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            langs, scores = np.full(len(batch), "und", object), np.zeros(len(batch))
            if m is not None:
                lettered = _letters(batch.column("low"))
                for i, j, x in _rows(batch.column("low")):
                    s = m.scores(x).astype(np.float64)
                    best = s.argmax(axis=1)
                    e = np.exp(4 * (s - s.max(axis=1)[:, None]))
                    ok = lettered[i:j]
                    langs[i:j][ok] = np.array(m.langs, object)[best][ok]
                    scores[i:j][ok] = (1 / e.sum(axis=1))[ok]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == HELD_OUT).alias("held_out"), F.lower("text").alias("low"))
    return rows.mapInArrow(scan, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))

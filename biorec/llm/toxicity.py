"""Toxicity by weak supervision.

Voters, one for each lexicon word, mined stem and text pattern, vote for a document by being present.
Stems are word beginnings that stand far more often in documents labelled toxic; further voters say
how many distinct words begin with one, and how densely. A lexicon word that labelled rows contradict
has no vote. A generative label model explains the votes of all documents by a latent class: given
the class, votes have a mean for each voter (its accuracy) and one covariance between voters (their
correlations), so voters that repeat each other count once. It is fitted by expectation
maximisation over all documents' votes, as Spark aggregates; labelled rows outside the held-out
fold have their label as class. Its posteriors, for labelled rows too, are the labels on which a linear
(logistic) classifier over the votes is trained; this scores every document over its whole text.

Labels are learnt only from rows outside the held-out fold; lang, source and doc_id are no inputs.
What reaches the driver: sums of votes and of their products (as many as there are pairs of voters);
the votes of about ``SAMPLE`` rows outside the held-out fold, drawn by a hash, equal ones once; and
at most ``STEMS`` stems, mined from about ``SAMPLE`` labelled rows.

A null or empty text has no votes and is scored like any text without them. Repeated rows are
scored alike. A document with several differing labels counts as toxic. With no labels the label
model starts from the voters' prior rates alone. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from biorec.llm.common import doc_key, few, fold, lean, materialize

HELD_OUT, THRESHOLD = 2, 0.3
SAMPLE = 20_000
STEMS, STEM_SIZES = 300, (4, 5, 6, 7, 8)
#: A stem is taken with so many toxic texts, and so many times the rate of clean ones. The first OWN stems are voters of their own.
STEM_LEAST, STEM_RATIO, OWN = 8, 6.0, 60
#: Rounds of expectation maximisation.
ROUNDS = 8

# Words of abuse in four languages, by kind.
LEXICON = {
    "mind": "cretin crétin crétine dumb dumm dummkopf estúpida estúpido idiot idiota idiote imbecile imbécil imbécile moron stupid stupide tonto trottel",
    "worth": "erbärmlich loser minable patético pathetic pathétique perdedor useless versager wertlos worthless",
    "filth": "abschaum basura dreck escoria filth garbage ordure racaille scum trash vermin",
    "ridicule": "bouffon buffoon clown fool jerk payaso witzfigur",
    "disgust": "asquerosa asqueroso disgusting dégoûtant ekelhaft repugnante repulsive revolting vile widerlich",
    "abuse": "arschloch asshole bastard bitch cabrón connard crap fuck fucking merde mierda puta putain salaud scheiße shit",
}
WORDS = tuple(w for words in LEXICON.values() for w in words.split())
_PLACE = {w: i for i, w in enumerate(WORDS)}
_GROUP = {w: g for g, words in enumerate(LEXICON.values()) for w in words.split()}
_ANY = "|".join(WORDS)
PATTERNS = {
    "addressed": re.compile(rf"(?i)\b(?:you|your|du|ihr|tu|vous|usted)\b(?:\W+\w+){{0,3}}?\W+(?:{_ANY})\b"),
    "named": re.compile(rf"(?i)\b(?:the|an?|this|that|le|la|une?|el|der|das|eine?)\W+(?:{_ANY})\b"),
    "shouted": re.compile("|".join(rf"\b{w.upper()}\b" for w in WORDS)),
}
#: Numbers of distinct words with a mined stem, and their share of all distinct words, from which a voter votes.
COUNTS, SHARES = (1, 2, 3, 5), (0.004, 0.02)
PLAIN = ("several", "repeated", *PATTERNS, "exclaims", "capitals", "masked", *(f"stems {n}" for n in COUNTS), *(f"stem share {x}" for x in SHARES), "clean")
#: The voters of each column of bits: the lexicon's words in two parts, the stems, the patterns.
PARTS = {"low": 60, "high": len(WORDS) - 60, "own": OWN, "votes": len(PLAIN)}
DIM = sum(PARTS.values())
_LETTERS = re.compile(r"[^\W\d_]+")
_MASK = re.compile(r"\w\*+\w")


class Known:
    """What the scan looks for: lexicon words that have a vote, and stems (the first of them voters of their own)."""

    def __init__(self, active: dict[str, int], stems: list[str]):
        self.active = active
        self.own = {w: i for i, w in enumerate(stems[:OWN])}
        self.stems = frozenset(stems)
        self.starts = frozenset(w[: STEM_SIZES[0]] for w in stems)

    def stem(self, word: str) -> str | None:
        if word[: STEM_SIZES[0]] in self.starts:
            for n in STEM_SIZES:
                if word[:n] in self.stems:
                    return word[:n]
        return None


def features(text: str, known: Known) -> tuple[int, int, int, int]:
    """The votes of a text as bits, by the columns of ``PARTS``."""
    words = _LETTERS.findall(text.lower())
    distinct = set(words)
    found = known.active.keys() & distinct
    stems = [s for w in distinct if (s := known.stem(w))] if known.starts else []
    bits = sum(1 << known.active[w] for w in found)
    own = 0
    for s in set(stems) & known.own.keys():
        own |= 1 << known.own[s]
    votes = [len(found) > 1, bool(found) and sum(w in found for w in words) > len(found)]
    votes += [bool(found) and p.search(text) is not None for p in PATTERNS.values()]
    votes += ["!!" in text, text.isupper(), _MASK.search(text) is not None]
    votes += [len(stems) >= n for n in COUNTS] + [len(stems) > 1 and len(stems) >= x * len(distinct) for x in SHARES]
    votes.append(not found and not stems)
    return bits & (1 << 60) - 1, bits >> 60, own, sum(v << k for k, v in enumerate(votes))


def _scan(known: Known):
    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(features(t.as_py() or "", known) for t in batch.column("text")))) if len(batch) else [()] * len(PARTS)
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *(pa.array(x, pa.int64()) for x in found)], [*kept, *PARTS])

    return scan


@lean
def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean texts each stem (and, after "=", each lexicon word) stands, a few texts at a time; after "#", the texts themselves."""
    for batch in batches:
        for at in range(0, len(batch), 128):
            part = batch.slice(at, 128)
            counts: tuple[Counter, Counter] = Counter(), Counter()
            for t, label in zip(part.column("text"), part.column("label").to_pylist()):
                words = set(_LETTERS.findall(t.as_py().lower()))
                counts[label].update({w[:n] for w in words for n in STEM_SIZES if len(w) >= n})
                counts[label].update("=" + w for w in _PLACE.keys() & words)
                counts[label]["#"] += 1
            keys = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], ["stem", "clean", "toxic"])


def mine(docs: DataFrame, given: DataFrame) -> Known:
    """Lexicon words with a vote and mined stems, from about SAMPLE labelled rows outside the held-out fold; equal texts count once."""
    open_ = given.where(fold() != HELD_OUT)
    drawn = open_.where(_draw("mine") < SAMPLE / max(1, open_.count()))
    texts = docs.where("text is not null").join(drawn, docs["doc_id"].cast("long") == drawn["doc_id"]).select("text", "label").groupBy("text").agg(F.max("label").alias("label"))
    counts = materialize(texts.mapInArrow(_candidates, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "stems")
    words = counts.where("stem like '=%'").collect()  # at most one row for each lexicon word
    active = {w: i for w, i in _PLACE.items() if w not in {r["stem"][1:] for r in words if r["clean"] >= 3 and r["clean"] > r["toxic"]}}
    every = counts.where("stem = '#'").first()
    if not every or not every["clean"] or not every["toxic"]:
        return Known(active, [])
    rate = (F.col("toxic") / every["toxic"]) / ((F.col("clean") + 0.5) / every["clean"])
    stems = counts.where(~F.col("stem").rlike("^[=#]") & (F.col("toxic") >= STEM_LEAST) & (rate >= STEM_RATIO)).orderBy(F.desc("toxic"), "stem").limit(STEMS).collect()
    top = {r["stem"] for r in stems}
    return Known(active, [r["stem"] for r in stems if not any(r["stem"][:n] in top for n in STEM_SIZES if n < len(r["stem"]))])


def _draw(seed: str, *columns: str) -> Column:
    """A number from 0 to 1 of the row's id and these columns."""
    key = F.concat_ws(":", F.lit(seed), doc_key(), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def matrix(columns: dict[str, np.ndarray]) -> np.ndarray:
    """Votes as 0 and 1, a column for each voter."""
    return np.hstack([(columns[c][:, None] >> np.arange(n) & 1).astype(np.float64) for c, n in PARTS.items()])


def _moments(batches: Iterator[pa.RecordBatch], posterior=None) -> Iterator[pa.RecordBatch]:
    """Without ``posterior``, the sums of products of votes, and of votes, over rows (i, j, x); with it, expected sums of votes in the second class."""
    total = np.zeros((DIM + 1, DIM + 1 if posterior is None else 1))
    for batch in (whole.slice(at, 2048) for whole in batches for at in range(0, len(whole), 2048)):
        n = batch.column("n").to_numpy().astype(np.float64)
        x = matrix({c: batch.column(c).to_numpy() for c in PARTS})
        one = np.hstack([x, np.ones((len(n), 1))])
        if posterior is None:
            total += (one * n[:, None]).T @ one
        else:
            label = batch.column("label").to_numpy()
            total[:, 0] += one.T @ (n * np.where(label >= 0, label, posterior(x)))
    i, j = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "x"])


def _summed(rows: DataFrame, width: int) -> np.ndarray:
    """Sums by (i, j), at most one row for each pair of voters."""
    out = np.zeros((DIM + 1, width))
    for r in rows.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        out[r["i"], r["j"]] = r["x"]
    return out


class LabelModel:
    """Two latent classes: each voter's mean in both, a covariance of voters given the class, and the second class's share."""

    def __init__(self):
        # Priors: voters on abuse are rare among clean texts; the three patterns of style say little.
        low, high = np.full(DIM, 0.005), np.full(DIM, 0.1)
        style = [DIM - len(PLAIN) + PLAIN.index(v) for v in ("exclaims", "capitals", "masked")]
        low[style] = high[style] = 0.1
        low[-1], high[-1] = 0.99, 0.2
        self.share, self.mean, self.covariance = 0.1, np.stack([low, high]), np.diag((low + high) / 2 * (1 - (low + high) / 2))
        self._solve()

    def _solve(self) -> None:
        shrunk = self.covariance + np.diag(np.diag(self.covariance) * 0.1 + 1e-3)
        self.weight = np.linalg.solve(shrunk, self.mean[1] - self.mean[0])
        middle = self.weight @ (self.mean[0] + self.mean[1]) / 2
        self.constant = np.log(self.share / (1 - self.share)) - middle

    def posterior(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weight + self.constant, -30, 30)))

    def update(self, products: np.ndarray, second: np.ndarray) -> None:
        """Maximise, given sums of products over all rows and expected sums in the second class (the last entry: rows)."""
        rows = products[-1, -1]
        for c, s in ((0, products[:-1, -1] - second[:-1]), (1, second[:-1])):
            n = second[-1] if c else rows - second[-1]
            # Each mean is held by a row of the middle.
            self.mean[c] = (s + products[:-1, -1] / rows) / (n + 1)
        share = min(max(second[-1] / rows, 1e-4), 0.5)
        within = products[:-1, :-1] / rows - (1 - share) * np.outer(self.mean[0], self.mean[0]) - share * np.outer(self.mean[1], self.mean[1])
        self.share, self.covariance = share, within - np.diag(np.minimum(np.diag(within), 0))
        self._solve()


def fit_label_model(patterns: DataFrame, rounds: int = ROUNDS) -> LabelModel:
    """Expectation maximisation over ``patterns(low, high, own, votes, label, n)``, where a label of -1 is unknown."""
    model = LabelModel()
    products = _summed(patterns.mapInArrow(_moments, "i int, j int, x double"), DIM + 1)
    if not products[-1, -1]:
        return model
    for _ in range(rounds):
        expected = patterns.mapInArrow(lambda batches, p=model.posterior: _moments(batches, p), "i int, j int, x double")
        model.update(products, _summed(expected, 1)[:, 0])
    return model


def logistic(x: np.ndarray, p: np.ndarray, count: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights by Newton steps on soft labels; the constant is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (count * s * (1 - s))[:, None]).T @ x + np.diag(shrink), x.T @ (count * (p - s)) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def votes_of(docs: DataFrame, labels: DataFrame, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One row per row of ``docs``: doc_id, fold and the votes' bits, with the column ``row`` if named; and the labels (doc_id, label)."""
    given = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    known = mine(docs, given)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold().alias("fold"), *([row] if row else []), "text")
    schema = StructType([x for x in rows.schema if x.name != "text"] + [StructField(c, LongType()) for c in PARTS])
    marked = materialize(rows.mapInArrow(_scan(known), schema), "votes")
    return marked, given


def score_toxicity(docs: DataFrame, labels: DataFrame, row: str | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, held_out, score, predicted; also the column ``row``, if named."""
    marked, given = votes_of(docs, labels, row)
    label = F.coalesce(F.when(F.col("fold") != HELD_OUT, F.col("label")), F.lit(-1)).alias("label")
    seen = marked.select("doc_id", "fold", *PARTS).join(given, "doc_id", "left").select("doc_id", "fold", *PARTS, label)
    patterns = materialize(seen.groupBy(*PARTS, "label").agg(F.count(F.lit(1)).alias("n")), "patterns")
    model = fit_label_model(patterns)

    # About SAMPLE rows, whatever the corpus.
    open_ = marked.where(F.col("fold") != HELD_OUT)
    share = SAMPLE / max(1, open_.count())
    # Rows of one id, or of none, draw apart by their votes; rows equal in both are one row of the sample.
    drawn = open_.where(_draw("toxic", *PARTS) < share).groupBy(*PARTS).agg(F.count(F.lit(1)).alias("n")).collect()
    drawn.sort(key=tuple)
    x = matrix({c: np.array([r[c] for r in drawn], np.int64) for c in PARTS})
    if len(drawn):
        w = logistic(np.hstack([np.ones((len(x), 1)), x]), model.posterior(x), np.array([r["n"] for r in drawn], np.float64))
    else:
        w = np.concatenate([[model.constant], model.weight])
    # Bit by bit, as a sum of JVM expressions.
    total, at = F.lit(float(w[0])), 1
    for column, n in PARTS.items():
        for k in range(n):
            if w[at + k]:
                total = total + F.shiftright(F.col(column), k).bitwiseAND(F.lit(1)) * F.lit(float(w[at + k]))
        at += n
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
    return marked.select("doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), score.alias("score"), *([row] if row else [])).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, each judged by its own score, whatever its id."""
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c] for c in docs.columns]).alias("doc")), "numbered")
    scored = score_toxicity(rows.select("row", "doc.doc_id", "doc.text"), labels, "row")
    # The rows that go are the fewer; whole rows stay out of the scan and of any shuffle.
    gone = materialize(scored.where("predicted = 1").select("row"), "toxic")
    return rows.join(few(gone), "row", "left_anti").select("doc.*")

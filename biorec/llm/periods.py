"""Runs of repeated words, found by recompression.

A run is a stretch of consecutive words with smallest period q and a length of at least
``max(least_length, exponent * q)`` that no neighbouring word extends keeping the period.

1. A slice of texts (about ``SLICE`` bytes, or one longer text) becomes one sequence of word numbers,
   with a separator of its own around each text. Words are told apart by their bytes.
2. Recompression makes a run-length grammar of the sequence: in turn, blocks of one symbol become a
   symbol for (symbol, count), and pairs of a left and a right symbol, by a random side for each
   symbol, become a symbol for the pair, until each text is a single symbol. Levels shrink by a
   constant factor. Separators take part in nothing.
3. Whether two places agree, and how far, is asked of the grammar: a query climbs while the two
   places keep agreeing on symbols of a level, and descends where they do not. By the rules of step 2
   equal stretches have equal symbols but for one at each end and level, so each level costs one
   comparison. Queries are answered many at a time, forwards and backwards alike.
4. A run of period q agrees with itself, q words on, for ``max(least_length, exponent * q) - q``
   places or more: one of them is on the grid of multiples of that number. Summed over all q the grids
   of a text of n words have O(n log n) places. From each that agrees, extending both ways gives the
   whole stretch. A stretch found under several periods has the smallest as its own.

No suffix array is made, and nothing is sampled or bounded: texts are whole. Memory is some tens of
bytes for each word of a slice, however many candidates there are. A null or empty text has no words
and no runs; repeated rows are treated each for itself; other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biorec.llm.common import NOT_SPACE, doc_key, mix, slices, utf8

EXPONENT = 4
LEAST_LENGTH = 6
#: Bytes of text that share a grammar.
SLICE = 1 << 20
#: Candidates looked at together.
GRID = 1 << 18
#: Bytes of a text that are split into words at a time.
STEP = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


# ---------------------------------------------------------------- the grammar


class Level(NamedTuple):
    symbols: np.ndarray
    #: For each symbol the place of its parent on the next level; None on the last level.
    up: np.ndarray | None
    #: For each symbol the place of its first child on the level before, and the number of all those; None on the first level.
    first: np.ndarray | None
    #: Made of blocks, not pairs.
    blocks: bool


def _named(keys: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
    """A new symbol for each distinct key, and the next free one."""
    distinct, at = np.unique(keys, return_inverse=True)
    return (fresh + at).astype(np.int32), fresh + len(distinct)


def grammar(symbols: np.ndarray) -> list[Level]:
    """The levels over ``symbols`` (int32): numbers from 0, and negative separators that differ from each other, also at both ends."""
    levels, s, first, blocks = [], symbols, None, False
    fresh = int(symbols.max(initial=-1)) + 1
    turn = 0

    def push(parts: np.ndarray, parents: np.ndarray, made: np.ndarray, of_blocks: bool) -> None:
        nonlocal s, first, blocks
        levels.append(Level(s, (np.cumsum(parents, dtype=np.int32) - 1).astype(np.int32), first, blocks))
        s, first, blocks = made, np.append(parts, len(parents)).astype(np.int32), of_blocks

    while True:
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        starts = np.flatnonzero(new)
        if len(starts) < len(s):
            count = np.diff(starts, append=len(s))
            made, many = s[starts], np.flatnonzero(count > 1)
            made[many], fresh = _named(made[many].astype(np.int64) << 32 | count[many], fresh)
            push(starts, new, made, True)
        inner = (s[:-1] >= 0) & (s[1:] >= 0)
        if not inner.any():
            levels.append(Level(s, None, first, blocks))
            return levels
        turn += 1
        left = mix(s.astype(np.uint64) + np.uint64(turn << 40)) >> np.uint64(63) > 0
        pairs = [np.flatnonzero(inner & (left[:-1] == way) & (left[1:] != way)) for way in (True, False)]
        at = max(pairs, key=len)
        if len(at):
            new = np.ones(len(s), bool)
            new[at + 1] = False
            names, fresh = _named(s[at].astype(np.int64) << 32 | s[at + 1], fresh)
            made = s.copy()
            made[at] = names
            push(np.flatnonzero(new), new, made[new], False)


def agree(levels: list[Level], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols agree from the places ``a`` and ``b`` (which differ) on, or from them backwards."""
    start, way = a, -1 if back else 1
    query = np.arange(len(a))

    def left(place: np.ndarray, parent: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Symbols from a place to the end of its parent, in the direction we go."""
        return place - first[parent] + 1 if back else first[parent + 1] - place

    stopped = []
    for level, above in zip(levels, levels[1:]):
        up, first = level.up, above.first
        pa_, pb = up[a], up[b]
        la, lb = left(a, pa_, first), left(b, pb, first)
        ready = (la == first[pa_ + 1] - first[pa_]) & (lb == first[pb + 1] - first[pb])
        equal = level.symbols[a] == level.symbols[b]
        step = np.where(~ready & equal, np.minimum(la, lb), 0) * way
        a, b = a + step, b + step
        on = ready | (equal & (la == lb))
        stopped.append((query[~on], a[~on], b[~on]))
        query, a, b = query[on], up[a[on]], up[b[on]]
    stopped.append((query, a, b))  # each text is one symbol, and its places differ

    query = a = b = np.zeros(0, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        if len(query):
            equal = level.symbols[a] == level.symbols[b]
            if levels[k + 1].blocks:
                first = levels[k + 1].first
                step = np.where(equal, np.minimum(left(a, level.up[a], first), left(b, level.up[b], first)), 0) * way
            else:
                step = equal * way
            a, b = a + step, b + step
        query, a, b = (np.concatenate(x) for x in zip((query, a, b), stopped[k]))
        if k:
            a, b = (level.first[x + 1] - 1 if back else level.first[x] for x in (a, b))
    out = np.empty(len(start), np.int64)
    out[query] = (a - start[query]) * way
    return out


# ---------------------------------------------------------------- runs


def _distinct(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each stretch once, with its smallest period, by start."""
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[new], length[new], period[new]


def find_runs(texts: list[np.ndarray], exponent: int = EXPONENT, least_length: int = LEAST_LENGTH, grid: int = GRID) -> tuple[np.ndarray, ...]:
    """All runs of several texts (int32 word numbers from 0): text, start, length, period; by text, start and period."""
    size = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(size + 1) - size  # after a separator
    s = np.full(int(size.sum()) + len(texts) + 1, -1, np.int32)
    s[base - 1] = -2 - np.arange(len(texts), dtype=np.int32)
    for t, at in zip(texts, base):
        s[at : at + len(t)] = t
    levels: list[Level] = []

    # One grid for each text and period.
    periods = np.where(size >= least_length, size // exponent, 0)
    text = np.repeat(np.arange(len(texts)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(least_length, exponent * period) - period
    places = np.where(size[text] >= step + period, -(-(size[text] - period) // step), 0)
    total = np.cumsum(places)
    found = []
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + grid, side="right")))
        n = places[at:end]
        k = np.repeat(np.arange(at, end), n)
        i = base[text[k]] + (np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)) * step[k]
        at = end
        j = i + period[k]
        # The place must agree, and one next to it where a run needs two such places.
        maybe = (s[i] == s[j]) & ((s[i + 1] == s[j + 1]) | (s[i - 1] == s[j - 1]) | (step[k] == 1))
        if not maybe.any():
            continue
        i, j, k = i[maybe], j[maybe], k[maybe]
        levels = levels or grammar(s)
        after, before = agree(levels, i, j), agree(levels, i - 1, j - 1, back=True)
        whole = after + before >= step[k]
        if whole.any():
            found.append(_distinct((i - before)[whole], (after + before + period[k])[whole], period[k][whole]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    start, length, period = _distinct(*(np.concatenate(x) for x in zip(*found)))
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    text = np.searchsorted(base, start, side="right") - 1
    return text, start - base[text], length, period


def words_of(text: bytes) -> Iterator[bytes]:
    """The words of a text, a part of it at a time."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + STEP)
        end = space.start() if space else len(text)
        yield from text[at:end].split()
        at = end


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1


def _joined(names: list[bytes], words: np.ndarray) -> bytes:
    parts = (words[k : k + STEP].tolist() for k in range(0, len(words), STEP))
    return b" ".join(b" ".join(map(names.__getitem__, p)) for p in parts)


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, least_length: int = LEAST_LENGTH) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, runs (array of start, length, period, by start), collapsed.

    ``collapsed`` has the words that are left, joined by single spaces, when each run keeps its first
    period alone: a word goes if any run has it after that run's first period.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets, SLICE):
                numbers = _Numbers()
                texts = [np.fromiter(map(numbers.__getitem__, words_of(data[offsets[r] : offsets[r + 1]].tobytes())), np.int32) for r in range(i, j)]
                text, start, length, period = find_runs(texts, exponent, least_length)
                names, collapsed = list(numbers), []
                per = np.searchsorted(text, np.arange(j - i + 1))
                for r, words in enumerate(texts):
                    mine = slice(per[r], per[r + 1])
                    if per[r] < per[r + 1]:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, start[mine] + period[mine], 1)
                        np.add.at(edge, start[mine] + length[mine], -1)
                        words = words[np.cumsum(edge[:-1]) == 0]
                    collapsed.append(_joined(names, words))
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(per, pa.int32()), runs),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def repeat_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by the checksum of its id, with the words from some place on repeated from there.

    With h the checksum, g = floor(h / 10) and n words, the words from a = g % n on become the first
    1 + floor((n - a) / (3 + g % 8)) of them, again and again. Other texts stay as they are.
    """
    h = F.crc32(doc_key())
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(words, a + i % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(F.lit(""))

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{NOT_SPACE}+"), F.lit(0))
    text = F.when(h % 10 == 0, F.get(F.transform(F.array(words), repeated), F.lit(0))).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def run_digests(runs: DataFrame) -> DataFrame:
    """Of ``periodic_runs``: doc_id, n_runs, the longest run (ties: smallest start, then period) and checksums of all runs and of the collapsed text."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    text = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    found = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("top.start"), F.col("top.length"), -F.col("top.period")
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

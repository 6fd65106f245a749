"""Byte-pair token counts by a heap and a linked list.

Texts are cut into pre-tokens; each pre-token's UTF-8 bytes are merged by repeatedly popping the
adjacent pair of the lowest rank (leftmost first). Tokens are counted as initial symbols minus
merges; no identifiers are made. Added tokens of the tokenizer file are found first, the way
the file's library does by default, and count 1 each.

A pre-token's count is kept in a cache of a fixed number of entries for each Python worker; a
pre-token of any length takes O(n log n). Texts are whole: nothing is truncated. A null text is
empty: 0 bytes, 0 tokens. Repeated rows are counted separately; extra columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 1 << 20
LIMIT = 512
# Fixed value: the pre-token pattern of byte-level tokenizers; white space as their library defines it.
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf" ?\p{{L}}+|'(?:s|t|re|ve|m|ll|d)| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the file: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_count(symbols: list[int], ranks: dict[int, int], made: list[int]) -> int:
    """Symbols that are left when no adjacent pair has a rank.

    ``ranks`` has the rank of the pair (a, b) at ``a << 32 | b``; ``made`` has, by rank, the symbol that the pair becomes.
    ``symbols`` is used up.
    """
    n = left = len(symbols)
    rank = ranks.get
    heap = [r << 32 | i for i, (a, b) in enumerate(itertools.pairwise(symbols)) if (r := rank(a << 32 | b)) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while heap:
        x = pop(heap)
        i, r = x & 0xFFFFFFFF, x >> 32
        if (a := symbols[i]) < 0 or (j := after[i]) >= n or rank(a << 32 | symbols[j]) != r:
            continue  # one of the pair has been merged since
        symbols[i] = a = made[r]
        symbols[j] = -1
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank(a << 32 | symbols[k])) is not None:
                push(heap, r << 32 | i)
        if (h := before[i]) >= 0 and (r := rank(symbols[h] << 32 | a)) is not None:
            push(heap, r << 32 | h)
    return left


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Callable[[str], int]:
    """The token counter of a byte-level BPE file, made once for each worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    of = byte_symbols()
    plain = lambda s: bytes(of[c] for c in s)
    symbol = {bytes([b]): b for b in range(256)}
    ranks, made = {}, []
    for m in spec["model"]["merges"]:
        a, b = map(plain, m if isinstance(m, list) else m.split(" "))
        made.append(symbol.setdefault(a + b, len(symbol)))
        ranks.setdefault(symbol[a] << 32 | symbol[b], len(made) - 1)
    find = regex.compile(PATTERN).findall
    added = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
    cut = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    class Cache(dict):
        def __missing__(self, word: str) -> int:
            n = merge_count(list(word.encode()), ranks, made)
            if len(self) >= CACHE:
                self.clear()
            if len(word) <= 64:
                self[word] = n
            return n

    cache = Cache()

    def count(text: str) -> int:
        total = 0
        for i, part in enumerate(cut.split(text) if cut and any(a in text for a in added) else (text,)):
            total += 1 if i % 2 else sum(map(cache.__getitem__, find(part)))
        return total

    return count


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_tokens, over_limit."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            tokens = [count(t) if (t := x.as_py()) else 0 for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

"""N-gram Jaccard self-join of documents, and its connected components.

A document's set is its distinct word 5-grams (A-Z lower-cased; white space as in the
contract); fewer words than five make one shingle of the whole sequence; no words or no
text make an empty set, linked with nothing. Two documents link when
``100 * |A & B| >= 75 * |A | B|``.

Steps, each a Spark job over all rows:

1. Scan: hash the shingles; give each set its size, its digest and a parity bitmap of hashed
   shingles of at least 2 n bits; add up a count sketch of all shingles (2^20 counters, whatever
   the input: shingles of more than some standard deviations of a counter are seen as frequent).
2. Scan: order each set rarest first by the sketch. Sets that link must share one of their
   first ``n - ceil(0.75 n) + 1`` shingles, so those are emitted as tile keys; the smaller set
   must have it among its first ``n - ceil(6 n / 7) + 1``, which a flag marks. Passages that
   many documents share come last in this order and seldom are tile keys. Tokens that very many
   sets hold are salted by set, and the heads of their salts make a tile of their own.
3. Within a tile, sets lie in size bands of width 4/3: only equal and neighbouring bands can
   link. Each set is first paired with the first set of its band and with its neighbour in
   size. The number of unequal bits of two bitmaps is at most the size of the symmetric
   difference, which bounds the overlap from above. Pairs left are intersected exactly, in
   blocks by the token they were found under.
4. Sets that step 3 connected need no more pairs among them. In tiles that still hold several
   components, all pairs of sets of different components are compared, by bitmaps first. Tiles
   are dealt out as pairs of blocks of 2048 sets; sets of a tile's largest component meet only
   those of the others.
5. The links of both rounds give the components.

So a group of copies or near copies of any size gives a number of pairs in proportion to its
size, while no link between different components is lost. Documents with equal sets are one
set (equal by a 64-bit digest of their shingles). Repeated rows and rows with equal ids behave as separate rows with one id; a null id
never becomes a component's id unless all of its ids are null. Extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from biorec.llm.common import components, few, lean, materialize, merged_sketch, mix, pieces, slices, utf8, word_hashes

SHINGLE = 5
PERCENT = 75
SKETCH_BITS = 20
BLOOM_BITS = 24
#: Sets in a block of a tile of several components.
BLOCK = 2048
#: About so many bytes of arrays are intersected at a time.
BLOCK_BYTES = 8 << 20
#: About so many sets are in one salt of a tile.
TILE_ROWS = 1 << 17
#: Least bits of a bitmap; a set of n shingles has the power of two of at least 2 n.
LEAST_BITS = 64
_COEF = mix(np.arange(11, 11 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def needed(n: int | np.ndarray) -> int | np.ndarray:
    """The smallest overlap that a set of n shingles has with any set it links to."""
    return -(-n * PERCENT // 100)


def index_length(n: int) -> int:
    """How many of its first shingles the smaller set of a pair that links must be searched under.

    No set of at least n shingles links to a set of n with an overlap of less than 2 PERCENT n / (100 + PERCENT).
    """
    return n - -(-2 * n * PERCENT // (100 + PERCENT)) + 1


# ---------------------------------------------------------------- shingles of one slice of rows


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows' distinct shingle hashes, ascending within a row, and where each row's begin (one more entry than rows)."""
    rows = len(offsets) - 1
    words, row = word_hashes(data, offsets)
    count = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    if len(words) >= SHINGLE:
        at = np.flatnonzero(row[: len(row) - SHINGLE + 1] == row[SHINGLE - 1 :])
        h = np.zeros(len(at), np.uint64)
        for k in range(SHINGLE):
            h += words[at + k] * _COEF[k]
        owner = row[at]
    else:
        h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short_h, short_owner = [], []
    for k in range(1, SHINGLE):
        r = np.flatnonzero(count == k)
        if len(r):
            s = np.full(len(r), k * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
            for j in range(k):
                s += words[first[r] + j] * _COEF[j]
            short_h.append(s)
            short_owner.append(r)
    if short_h:
        h, owner = np.concatenate([h, *short_h]), np.concatenate([owner, *short_owner])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    h = mix(h)
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]) if len(owner) else np.zeros(rows + 1, np.int64)
    for i in np.flatnonzero(np.diff(starts) > 1):
        h[starts[i] : starts[i + 1]].sort()
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
        starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])
    return h, starts


def set_ids(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit id of each row's set, from its members' hashes and its size; rows with equal sets get equal ids."""
    n = np.diff(starts)
    out = np.zeros(len(n), np.uint64)
    full = n > 0
    if full.any():
        out[full] = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)), starts[:-1][full])
    return mix(out + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def bitmap_bits(n: int) -> int:
    return max(LEAST_BITS, 1 << int(2 * n - 1).bit_length())


def bitmap(h: np.ndarray, bits: int) -> bytes:
    """Parity of the number of shingles hashed to each bit."""
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(blobs: list[bytes], bits: int) -> np.ndarray:
    """Bitmaps brought to one length: parity bitmaps fold by exclusive or."""
    out = np.empty((len(blobs), bits // 64), np.uint64)
    for i, blob in enumerate(blobs):
        x = np.frombuffer(blob, np.uint64)
        while len(x) * 64 > bits:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def may_link(n1, n2, unequal) -> np.ndarray:
    """Can sets of these sizes link, when at least ``unequal`` shingles are in one of them only?"""
    both = (n1 + n2 - unequal) // 2
    return np.minimum(both, np.minimum(n1, n2)) * 100 >= PERCENT * (n1 + n2 - np.minimum(both, np.minimum(n1, n2)))


# ---------------------------------------------------------------- scans


@lean
def _scan_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and id of each row's set; the bitmap of each set once a task; the task's part of the sketch."""
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    seen: set[int] = set()
    names = ["doc_id", "n", "sid", "bitmap", "piece", "blob"]
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for i, j in slices(offsets):
            h, starts = shingle_sets(data, offsets[i : j + 1])
            sketch += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            n, ids = np.diff(starts), set_ids(h, starts)
            marks: list[bytes | None] = [None] * (j - i)
            for r in np.flatnonzero(n):
                if (sid := int(ids[r])) not in seen:
                    seen.add(sid)
                    marks[r] = bitmap(h[starts[r] : starts[r + 1]], bitmap_bits(int(n[r])))
            none = pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), pa.array(ids), pa.array(marks, pa.binary()), *none], names)
    part = pieces(np.minimum(sketch, np.iinfo(np.uint32).max).astype(np.uint32))
    none = pa.nulls(len(part), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(part), pa.binary()), part.column("piece"), part.column("blob")], names)


def _scan_prefixes(sketch, tile_rows: int):
    """The rarest shingles of each set, as many as a link needs one of, once a task.

    A token that far more than ``tile_rows`` sets hold, by the sketch, has several salts.
    """

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = sketch.value.astype(np.int64)
        salts = 1 + np.maximum(plain - int(plain.mean()), 0) // tile_rows
        counts = np.minimum(plain, (1 << 23) - 1).astype(np.uint64)
        seen: set[int] = set()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets):
                h, starts = shingle_sets(data, offsets[i : j + 1])
                ids, n = set_ids(h, starts), np.diff(starts)
                place = (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                keys = (counts[place] << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))
                take, which, leads = [], [], []
                for r in np.flatnonzero(n):
                    if (sid := int(ids[r])) in seen:
                        continue
                    seen.add(sid)
                    k = keys[starts[r] : starts[r + 1]]
                    p = int(n[r] - needed(n[r]) + 1)
                    at = np.argpartition(k, p - 1)[:p] if p < len(k) else np.arange(len(k))
                    at = at[np.argsort(k[at])]
                    take.append(starts[r] + at)
                    leads.append(k[at] <= k[at[index_length(int(n[r])) - 1]])
                    which.append(r)
                if take:
                    rows, at = np.repeat(np.array(which), [len(k) for k in take]), np.concatenate(take)
                    many = salts[place[at]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[at].view(np.int64)), pa.array(np.where(many > 1, (ids[rows].view(np.uint64) % many.astype(np.uint64)).astype(np.int64), -1).astype(np.int32)),
                            pa.array((n[rows] * 2 + np.concatenate(leads)).astype(np.int64)), pa.array(ids[rows]),
                        ],
                        ["token", "salt", "size_lead", "sid"],
                    )

    return scan


def _places(sid: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(sid.view(np.uint64) + doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BLOOM_BITS)


@lean
def _bloom_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A filter of 2^24 bits, which only spares work: what passes wrongly joins with nothing later."""
    on = np.zeros(1 << BLOOM_BITS - 3, np.uint8)
    for batch in batches:
        for sid, doc in (("u", "du"), ("v", "dv")):
            at = _places(*(batch.column(c).to_numpy(zero_copy_only=False) for c in (sid, doc)))
            np.bitwise_or.at(on, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    yield pieces(on)


def _scan_sets(bloom):
    """The sorted shingle hashes of the sets that the filter asks for, from the row that stands for each set, once a task."""

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value
        seen: set[int] = set()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                h, starts = shingle_sets(data, offsets[i : j + 1])
                ids, n = set_ids(h, starts), np.diff(starts)
                at = _places(ids, doc[i:j])
                asked = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                rows = [r for r in np.flatnonzero((n > 0) & asked) if not (int(ids[r]) in seen or seen.add(int(ids[r])))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array([h[starts[r] : starts[r + 1]].tobytes() for r in rows], pa.binary())], ["sid", "data"])

    return scan


# ---------------------------------------------------------------- pairs

PAIR = "u long, v long, home long, nu long, nv long, du long, dv long"


@lean
def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps do not rule a link out."""
    for batch in batches:
        nu, nv = (batch.column(c).to_numpy().astype(np.int64) for c in ("nu", "nv"))
        bu, bv = (batch.column(c).to_pylist() for c in ("bu", "bv"))
        keep = np.zeros(len(nu), bool)
        width = np.minimum([len(x) for x in bu], [len(x) for x in bv]) if len(nu) else np.zeros(0, int)
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            x = folded([bu[i] for i in at], int(w) * 8) ^ folded([bv[i] for i in at], int(w) * 8)
            keep[at] = may_link(nu[at], nv[at], np.bitwise_count(x).sum(axis=1).astype(np.int64))
        yield batch.select(["u", "v", "home", "nu", "nv", "du", "dv"]).filter(pa.array(keep))


def _intersected(members: pa.Table, pairs: pa.Table) -> pa.Table:
    """Pairs of one block that link, by exact intersection of sorted arrays; each array comes once for the block."""
    of = {sid.as_py(): np.frombuffer(m.as_buffer(), np.uint64) for sid, m in zip(members["sid"], members["data"])}
    keep = []
    for u, v in zip(pairs["u"].to_pylist(), pairs["v"].to_pylist()):
        x, y = of[u], of[v]
        at = np.searchsorted(x, y)
        both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
        keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
    return pairs.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, text: DataFrame, block_bytes: int) -> DataFrame:
    """The pairs that link, by exact intersection.

    Pairs are checked in blocks of about ``block_bytes`` of arrays: pairs found under one token share
    a block, so that most sets go to a few blocks; a token with more pairs is dealt over several.
    """
    total = pairs.agg(F.sum(F.col("nu") + F.col("nv"))).first()[0] or 0
    side = int(max(4, total * 8 // block_bytes))
    large = pairs.groupBy("home").agg(F.ceil(F.sum("nu") * 8 / block_bytes).alias("k")).where("k > 1")
    block = F.pmod(F.xxhash64("home", F.pmod(F.xxhash64("u"), F.coalesce("k", F.lit(1)))), F.lit(side)).cast("int")
    blocked = materialize(pairs.join(large, "home", "left").select("u", "v", "du", "dv", block.alias("b")), "blocks")
    bits = merged_sketch(blocked.mapInArrow(_bloom_parts, "piece int, blob binary"), 1 << BLOOM_BITS - 3, "uint8", np.bitwise_or)
    shared = text.sparkSession.sparkContext.broadcast(bits)
    places = blocked.select(F.explode(F.array("u", "v")).alias("sid"), F.col("b").alias("place")).distinct()
    sent = text.mapInArrow(_scan_sets(shared), "sid long, data binary").join(places, "sid")
    links = materialize(sent.groupBy("place").cogroup(blocked.groupBy("b")).applyInArrow(_intersected, "u long, v long"), "links")
    shared.destroy()
    return links


def _compared(held: dict[str, np.ndarray | list]) -> pa.RecordBatch | None:
    """Pairs of sets of one tile that are of different components and may link."""
    n, label, sid, doc, salt, home, lead = (held[c] for c in ("n", "label", "sid", "doc", "salt", "home", "lead"))
    marks = folded(held["bitmap"], min(len(x) for x in held["bitmap"]) * 8)
    lo, hi = held["lo"][0], held["hi"][0]
    first, second = (np.flatnonzero(salt == s) for s in (lo, hi))
    if len(first) > len(second):
        first, second = second, first
    us, vs = [], []
    for at, i in enumerate(first):
        rest = second if lo != hi else first[at + 1 :]
        # At least one of a pair is at home in the tile's band. The smaller set must be searched
        # under this token; of sets of one size, both.
        ok = (label[rest] != label[i]) & (home[rest] | home[i]) & (lead[rest] | (n[rest] > n[i])) & (lead[i] | (n[rest] < n[i]))
        rest = rest[ok]
        if len(rest):
            rest = rest[may_link(n[rest], n[i], np.bitwise_count(marks[rest] ^ marks[i]).sum(axis=1).astype(np.int64))]
            us.append(np.full(len(rest), i))
            vs.append(rest)
    if not us:
        return None
    u, v = np.concatenate(us), np.concatenate(vs)
    swap = (n[u] < n[v]) | ((n[u] == n[v]) & (sid[u] < sid[v]))
    u, v = np.where(swap, v, u), np.where(swap, u, v)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (sid[u], sid[v], held["token"][u], n[u], n[v], doc[u], doc[v])], ["u", "v", "home", "nu", "nv", "du", "dv"])


@lean
def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the sets of each tile, which arrive sorted by tile: at most two blocks of sets at a time are held."""
    held: pa.Table | None = None

    def runs(table: pa.Table, last: bool) -> Iterator[tuple[int, int]]:
        key = [table[c].to_numpy() for c in ("token", "band", "lo", "hi")]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        bounds = [0, *new.tolist(), table.num_rows]
        yield from zip(bounds[:-1] if last else bounds[:-2], bounds[1:] if last else bounds[1:-1])

    def done(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        for i, j in runs(table, last):
            if j - i > 1:
                part = table.slice(i, j - i)
                got = _compared({c: part[c].to_pylist() if c == "bitmap" else part[c].to_numpy() for c in part.column_names})
                if got is not None:
                    yield got

    for batch in batches:
        if not len(batch):
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        yield from done(held, False)
        rest = list(runs(held, True))[-1][0]
        held = held.slice(rest).combine_chunks()
    if held is not None:
        yield from done(held, True)


def _neighbours(rows: DataFrame, *tile: str) -> DataFrame:
    """``rows`` with the head of each set's band in its tile, and its neighbours in size if a link is possible."""
    by_size = Window.partitionBy(*tile).orderBy("band", "n", "sid")
    earlier = by_size.rowsBetween(Window.unboundedPreceding, -1)
    by_band = Window.partitionBy(*tile, "band").orderBy("n", "sid")
    near = lambda s, a, b: F.col(s).isNotNull() & (F.col(s) != F.col("sid")) & (F.col(a) * 100 >= F.col(b) * PERCENT)
    lead = lambda c: F.last(F.when(F.col("lead"), F.col(c)), ignorenulls=True).over(earlier)
    out = rows.withColumns({"below": lead("sid"), "n0": lead("n"), "above": F.lead("sid").over(by_size), "n2": F.lead("n").over(by_size)})
    out = out.withColumn("head", F.first("sid").over(by_band))
    out = out.withColumns({"down": near("below", "n0", "n"), "up": F.col("lead") & near("above", "n", "n2")})
    return out.withColumn("below", F.when(F.col("down"), F.col("below"))).drop("n0", "above", "n2")


def _chained(tiles: DataFrame) -> DataFrame:
    pairs = tiles.select("token", "sid", F.explode(F.array("head", "below")).alias("other")).where("other is not null and other != sid")
    return pairs.select(F.col("sid").alias("u"), F.col("other").alias("v"), "token")


def link_sets(docs: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Tables of (doc_id, n, sid), one row per row of ``docs``, and (sid, label) for linked sets."""
    sc = docs.sparkSession.sparkContext
    no_id = F.lit(-(1 << 63))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = text.select(F.coalesce("doc_id", no_id).alias("doc_id"), "text")
    scanned = materialize(text.mapInArrow(_scan_sizes, "doc_id long, n long, sid long, bitmap binary, piece int, blob binary"), "sizes")
    sizes = scanned.where("piece is null").select("doc_id", "n", "sid")
    sketch = sc.broadcast(merged_sketch(scanned.where("piece is not null").select("piece", "blob"), 1 << SKETCH_BITS, "uint32"))
    marks = scanned.where("bitmap is not null").groupBy("sid").agg(F.first("n").alias("n"), F.min(F.coalesce("doc_id", no_id)).alias("doc"), F.first("bitmap").alias("bitmap"))

    prefixes = text.select("text").mapInArrow(_scan_prefixes(sketch, tile_rows), "token long, salt int, size_lead long, sid long").repartition("token", "salt")
    prefixes = prefixes.select("token", "salt", F.shiftright("size_lead", 1).cast("int").alias("n"), "sid", (F.col("size_lead") % 2 == 1).alias("lead"))
    prefixes = prefixes.withColumn("band", F.floor(F.log("n") / math.log(100 / PERCENT)).cast("int"))
    tiles = materialize(_neighbours(prefixes, "token", "salt").where("down or up or salt >= 0").drop("down", "up"), "tiles")
    sketch.destroy()

    # Sets are tied to the head of their band and their neighbour; the heads of a token's salts likewise.
    heads = _neighbours(tiles.where("salt >= 0 and sid = head").select("token", "n", "sid", "lead", "band").distinct(), "token")
    pairs = _chained(tiles).unionByName(_chained(heads)).groupBy("u", "v").agg(F.min("token").alias("home"))
    first, second = marks.toDF("u", "nu", "du", "bu"), marks.toDF("v", "nv", "dv", "bv")
    bounded = materialize(pairs.join(first, "u").join(second, "v").mapInArrow(_bounded, PAIR), "pairs")
    links = _verified(bounded, keyed, block_bytes)
    label = components(links)

    # Tiles that hold sets of several components: all pairs of different components, by blocks. The
    # sets of a tile's largest component meet those of the others only.
    labelled = tiles.select("token", "sid", "n", "band", "lead").distinct().join(label.withColumnRenamed("u", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    mixed = labelled.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("sid", "lead")).alias("x"))
    mixed = mixed.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.max("c").alias("c"), F.sum("c").alias("m"), F.bit_xor("x").alias("x"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    # Tokens with the same sets, as those of one shared passage, make the same tile.
    mixed = mixed.groupBy("x", "m").agg(F.min_by(F.struct("token", "most", "c"), "token").alias("t")).select("t.*", F.ceil((F.col("m") - F.col("t.c")) / block).cast("int").alias("few"), F.ceil(F.col("t.c") / block).cast("int").alias("many"))
    rows = labelled.join(mixed, "token").join(marks.select("sid", "doc", "bitmap"), "sid")
    own = F.col("label") == F.col("most")
    rows = rows.withColumn("salt", F.when(own, F.col("few") + F.pmod(F.xxhash64("sid"), F.col("many"))).otherwise(F.pmod(F.xxhash64("sid"), F.col("few"))).cast("int"))
    others = F.when(own, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    rows = rows.withColumn("others", others).withColumn("tile", F.explode(F.expr("flatten(transform(array(band, band + 1), b -> transform(sequence(0, others), s -> struct(b as band, least(s, salt) as lo, greatest(s, salt) as hi))))")))
    rows = rows.select("token", "tile.*", (F.col("tile.band") == F.col("band")).alias("home"), "salt", "sid", "doc", "n", "lead", "label", "bitmap")
    rows = rows.repartition("token", "band", "lo", "hi").sortWithinPartitions("token", "band", "lo", "hi")
    found = rows.mapInArrow(_tiles, PAIR).groupBy("u", "v").agg(F.min("home").alias("home"), *[F.min(c).alias(c) for c in ("nu", "nv", "du", "dv")])
    found = materialize(found, "pairs")
    if not found.limit(1).count():
        return sizes, label.withColumnRenamed("u", "sid")
    more = _verified(found, keyed, block_bytes)

    ends = more.join(label.toDF("u", "lu"), "u", "left").join(label.toDF("v", "lv"), "v", "left")
    joined = components(ends.select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v")))
    # A set's label, then what the second round joined that label with.
    known = label.select(F.col("u").alias("sid"), "label").unionByName(joined.select(F.col("u").alias("sid"), F.col("u").alias("label")))
    known = known.groupBy("sid").agg(F.min("label").alias("label"))
    final = known.join(joined.toDF("label", "top"), "label", "left").select("sid", F.coalesce("top", "label").alias("label"))
    return sizes, materialize(final, "labels")


def components_of(sizes: DataFrame, label: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row, given what ``link_sets`` returns."""
    per_set = sizes.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    per_set = per_set.join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    top = per_set.groupBy("label").agg(F.min("least").alias("component_id"))
    named = per_set.join(top, "label").select("sid", "component_id")
    return sizes.join(named, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def ngram_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id."""
    return components_of(*link_sets(docs))


def keep_one_per_component(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group: the smallest id (null ids last), then any one row of that id.

    Rows without words are their own components and stay.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c] for c in docs.columns]).alias("doc")), "numbered")
    # Row numbers stand in for ids, so that each row of a repeated or null id is told apart.
    sizes, label = link_sets(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")))
    ids = rows.select(F.col("row").alias("doc_id"), F.col("doc.doc_id").cast("long").alias("id"))
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "doc_id"))
    worded = sizes.where("n > 0").select("doc_id", "sid")
    per_set = worded.join(ids, "doc_id").groupBy("sid").agg(best.alias("best"))
    per_set = per_set.join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    stay = per_set.groupBy("label").agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias("row"))
    # The rows that go are the fewer.
    gone = materialize(worded.select(F.col("doc_id").alias("row")).join(stay, "row", "left_anti"), "gone")
    return rows.join(few(gone), "row", "left_anti").select("doc.*")

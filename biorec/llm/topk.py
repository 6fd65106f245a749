"""Exact top-k search by inner product, with multi-resolution segment statistics.

Vectors are quantised to floor(256 x), x as double. For a query q and a candidate c the squared
distance is |q|^2 + |c|^2 - 2 <q, c>, so a lower bound of the distance is an upper bound of the
product. With the means and deviations of both over segments, <q, c> is at most the sum over
segments of length * (mean_q mean_c + dev_q dev_c). Bounds are taken over 1, 4 and 16 segments in
turn; a candidate whose bound is under the query's k-th best product so far is dropped, and the
exact integer products are computed for the survivors only. The k-th best product so far is kept
from block to block within a task.

Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's
own row. Both come in blocks: every block of candidates meets every block of queries, which is the
query set against all rows. Candidates are dealt over as many tasks as there are blocks, up to a
few for each core; each task gets the queries' blocks. Each pair of blocks leaves k rows for a
query, and a ranking per query merges these. Ties go to the smaller id.

Vectors that are null or hold null or non-finite components take no part; nor do rows without an
id. Vectors of different lengths aren't compared. Rows are told apart by number: of rows with one
id each is a query of its own, with ranks of its own, and a candidate for the others. Vectors with
a component of 2^23 or more after quantisation are multiplied as integers of any size; a score that
does not fit a long is given as the nearest long, and ranked by its exact value. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from biorec.llm.common import materialize

K, EVERY = 5, 50
QUERY_BLOCK, BLOCK = 512, 4096
LEVELS = (1, 4, 16)
#: Tasks for each core, at most.
TASKS = 4
#: From here on components are multiplied as integers of any size; below, sums of products fit 64 bits.
LARGE = 1 << 23
#: Blocks whose arrays and statistics a task keeps at hand.
AT_HAND = 32
MOST = (1 << 63) - 1


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Numbered rows (row, id, v) that take part, with whether they are large."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    rows = vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("v"))
    rows = rows.where(F.forall("v", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf")))))
    large = F.exists("v", lambda v: F.abs(v) >= F.lit(LARGE / 256))
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "id", large.alias("large"), "v"), "vectors")


def _blocks(size: int):
    """Pack rows into blocks of one vector length, large ones apart: (dim, large, number, rows, ids, vecs)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[list]] = {}

        def out(key: tuple[int, bool]) -> pa.RecordBatch:
            rows, ids, vs = (np.concatenate(x) for x in held.pop(key))
            # Each block is known by its first row.
            fields = [key[0], key[1], int(rows[0]), rows.tobytes(), ids.tobytes(), vs.tobytes()]
            types = [pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(fields, types)], ["dim", "large", "number", "rows", "ids", "vecs"])

        for batch in batches:
            row, ids = batch.column("row").to_numpy(), batch.column("id").to_numpy()
            large = batch.column("large").to_numpy(zero_copy_only=False)
            lists = batch.column("v")
            starts = lists.offsets.to_numpy().astype(np.int64)
            values, dims = lists.values.to_numpy(zero_copy_only=False), np.diff(starts)
            for dim in np.unique(dims):
                for big in (False, True):
                    at = np.flatnonzero((dims == dim) & (large == big))
                    for part in np.array_split(at, -(-len(at) // size)) if len(at) else ():
                        v = values[starts[part][:, None] + np.arange(dim)].reshape(len(part), dim)
                        key = int(dim), big
                        for kept, new in zip(held.setdefault(key, [[], [], []]), (row[part], ids[part], v if big else np.floor(v * 256).astype(np.int32))):
                            kept.append(new)
                        if sum(map(len, held[key][0])) >= size:
                            yield out(key)
        for key in list(held):
            yield out(key)

    return pack


class Block:
    """Rows of one vector length, with segment means and deviations (each times the root of the segment's length)."""

    def __init__(self, dim: int, large: bool, rows: bytes, ids: bytes, vecs: bytes):
        self.rows, self.ids = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64)
        self.large = large
        n = len(self.ids)
        if large:
            whole = lambda x: math.floor(x * 256) if abs(x) < 2.0**1000 else int(x) * 256
            self.v = np.array([whole(x) for x in np.frombuffer(vecs, np.float64).tolist()] + [None], object)[:-1].reshape(n, dim)
            return
        self.v = np.frombuffer(vecs, np.int32).astype(np.int64).reshape(n, dim)
        f = self.v.astype(np.float64)
        self.length = np.sqrt((f**2).sum(axis=1)).max(initial=0.0)
        self.levels = []
        for level in LEVELS if dim else ():
            parts = np.array_split(np.arange(dim), min(level, dim))
            self.levels.append(np.hstack([np.stack([g(f[:, p], axis=1) * np.sqrt(len(p)) for p in parts], axis=1) for g in (np.mean, np.std)]))


def top_of_block(q: Block, c: Block, k: int, floors: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query of a block (by place): its k best candidates of a block and their products.

    ``floors`` holds each query's k-th best product of earlier blocks, and is raised.
    """
    bounded = not (q.large or c.large) and bool(q.levels)
    if bounded:
        slack = 1e-6 * (1 + q.length * c.length)
        coarse = q.levels[0] @ c.levels[0].T + slack
    for n in range(len(q.rows)):
        alive = np.flatnonzero(c.rows != q.rows[n])
        if bounded:
            floor = float(floors[n]) if floors is not None else -np.inf
            if len(alive) > k:
                # The candidates with the best coarse bounds give a first k-th best product.
                seed = alive[np.argpartition(-coarse[n, alive], k - 1)[:k]]
                floor = max(floor, float((c.v[seed] @ q.v[n]).min()))
            alive = alive[coarse[n, alive] >= floor]
            for qb, cb in zip(q.levels[1:], c.levels[1:]):
                if not len(alive):
                    break
                upper = cb[alive] @ qb[n] + slack
                if len(alive) > k:
                    best = alive[np.argpartition(-upper, k - 1)[:k]]
                    floor = max(floor, float((c.v[best] @ q.v[n]).min()))
                alive = alive[upper >= floor]
        if not len(alive):
            continue
        score = (c.v[alive].astype(object) if q.large else c.v[alive]) @ q.v[n] if q.v.shape[1] else np.zeros(len(alive), np.int64)
        order = np.array(sorted(range(len(alive)), key=lambda i: (-score[i], c.ids[alive[i]]))[:k]) if score.dtype == object else np.lexsort((c.ids[alive], -score))[:k]
        if bounded and floors is not None and len(order) == k:
            floors[n] = max(floors[n], float(score[order[-1]]))
        yield n, c.ids[alive][order], score[order]


def _key(x: int) -> bytes | None:
    """For integers beyond 64 bits: bytes in their order (length and digits, inverted below zero); else null."""
    if -MOST - 1 <= x <= MOST:
        return None
    size = (abs(x).bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + abs(x).to_bytes(size, "big")
    return raw if x > 0 else bytes(255 - b for b in raw)


def _search(k: int):
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.int32()), ("exact", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple, Block] = {}
        floors: dict[int, np.ndarray] = {}

        def block(kind: str, r: dict) -> Block:
            key = kind, r[f"{kind}_number"], r["dim"], r[f"{kind}_large"]
            if key not in blocks:
                if len(blocks) >= AT_HAND:
                    blocks.pop(next(iter(blocks)))
                blocks[key] = Block(r["dim"], r[f"{kind}_large"], r[f"{kind}_rows"], r[f"{kind}_ids"], r[f"{kind}_vecs"])
            return blocks[key]

        for batch in batches:
            for i in range(len(batch)):
                r = batch.slice(i, 1).to_pylist()[0]
                q, c = block("q", r), block("c", r)
                known = floors.setdefault((r["q_number"], r["dim"], r["q_large"]), np.full(len(q.rows), -np.inf))
                found = list(top_of_block(q, c, k, known))
                if found:
                    at = np.concatenate([np.full(len(v), n) for n, v, _ in found])
                    score = [int(x) for _, _, s in found for x in s]
                    short = [min(MOST, max(-MOST - 1, x)) for x in score]
                    beyond = [(x > MOST) - (x < -MOST - 1) for x in score]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q.rows[at]), pa.array(q.ids[at]), pa.array(np.concatenate([v for _, v, _ in found])), pa.array(short, pa.int64()), pa.array(beyond, pa.int32()), pa.array([_key(x) for x in score], pa.binary())],
                        schema=schema,
                    )

    return scan


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest products."""
    rows = _usable(vectors, id_col, vec_col)
    asked = rows.where(F.col("id") % every == 0)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).first()
    spread = max(1, min(-(-counts["n"] // BLOCK), TASKS * vectors.sparkSession.sparkContext.defaultParallelism))
    kind = "dim int, large boolean, number long, rows binary, ids binary, vecs binary"
    named = lambda df, c: df.select("dim", *[F.col(x).alias(f"{c}_{x}") for x in ("large", "number", "rows", "ids", "vecs")], "part")
    # Queries are few in each input partition: brought together first, so that blocks are full.
    q = asked.repartition(max(1, -(-counts["q"] // QUERY_BLOCK)), "row").mapInArrow(_blocks(QUERY_BLOCK), kind)
    q = named(q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))), "q")
    c = named(rows.repartition(spread, "row").mapInArrow(_blocks(BLOCK), kind).withColumn("part", F.pmod(F.xxhash64("number"), F.lit(spread)).cast("int")), "c")
    met = c.join(q, ["dim", "part"]).drop("part")
    found = met.mapInArrow(_search(k), "query_row long, query_id long, vec_id long, score long, beyond int, exact binary")
    order = Window.partitionBy("query_row").orderBy(F.desc("beyond"), F.desc("exact"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH e AS (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rn, q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM e q JOIN e c ON q.rn <> c.rn AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) <= 5
"""

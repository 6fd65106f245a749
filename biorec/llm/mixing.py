"""Mix sources to target weights by repeating documents.

Sizes are words (runs without the contract's white space; null text: 0). All sources together
get ``share`` times all words, dealt out by weight; a source gets at most ``most`` times its own
size, and what it cannot take is dealt out again by weight among the rest. A document of a
source whose rate is r = target / size is emitted floor(r) times, plus once more with
probability r - floor(r), drawn from a hash of the seed, its id and its text: reruns agree.

Only DataFrame functions are used. The join of documents to their source's rate is an ordinary
one: Spark broadcasts the table of sources if it is small, else splits a hot source's rows.

Null sources are one source, which comes last; sources of size 0 have target and rate 0. Rows of one
id, or of none, draw apart if their texts differ; rows equal in id, text and source are numbered and
draw apart by their numbers, so that however many they are their source comes near its target (which
of them has which number is open, as they are alike). Extra columns pass through (``mix_sources``),
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from biorec.llm.common import NOT_SPACE, doc_key, few, materialize

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
SEED = "mix"


def words(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(NOT_SPACE + "+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Add ``rank`` from 0 in code point order, null last, without one task that holds all sources."""
    parts = sources.orderBy(F.col("source").asc_nulls_last()).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    parts = materialize(parts, "sources")
    # One row for each partition of the sort: at most as many as shuffle partitions.
    counts = sorted((r["part"], r["first"], r["n"]) for r in parts.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).collect())
    base, shifts = 0, []
    for part, first, n in counts:
        shifts.append((part, base - first))
        base += n
    offsets = sources.sparkSession.createDataFrame(shifts, "part int, shift long")
    # A table of its own, so that its size is known where it is joined.
    return materialize(parts.join(F.broadcast(offsets), "part").withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift"), "ranked")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of ``sizes(source, size)``."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = _ranked(totals)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight, "most": F.col("source_size") * F.lit(most)})
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    # Deal out again until no source is above its most; each pass is one aggregate over the sources.
    above, level, fixed = F.lit(False), 0.0, -1
    while True:
        row = ranked.agg(
            F.sum(F.when(above, F.col("most")).otherwise(0.0)).alias("taken"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weight"), F.count(F.when(above, 1)).alias("n")
        ).first()
        if not row["weight"] or row["n"] == fixed:
            break
        fixed = row["n"]
        rest, weight_left = total - row["taken"], row["weight"]
        level = F.col("weight") * F.lit(rest) / F.lit(weight_left)
        above = above | (level >= F.col("most"))
    target = F.when(above, F.col("most")).otherwise(level) if fixed >= 0 else F.lit(0.0)
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def copies(rate: Column, key: Column, seed: str = SEED) -> Column:
    """floor(rate), plus 1 with probability of the fraction, by the first 52 bits of an md5 of the seed and the key."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("long")


def _drawing_apart(rows: DataFrame) -> DataFrame:
    """``rows(key, source, ...)`` with a key of its own for each row: rows alike in both get numbers from 0, and those over 0 are added to the key.

    Only the keys are shuffled to find such rows. They are numbered within the parts that they come in,
    and each part goes on where those before it end: no task gets all rows of one key.
    """
    alike = [F.col("key"), F.coalesce("source", F.lit("")).alias("_named"), F.col("source").isNull().alias("_none")]
    keys = ["key", "_named", "_none"]
    twins = materialize(rows.select(*alike).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "twins")
    if not twins.limit(1).count():
        return rows
    twins, marked = few(twins), rows.select("*", *alike[1:])
    lone = marked.join(twins, keys, "left_anti")
    found = materialize(marked.join(twins, keys, "left_semi").withColumn("_part", F.spark_partition_id()), "twin-rows")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = found.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("n")).withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    at = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(F.lit(0))) - 1 + F.col("_base")
    numbered = found.join(parts, [*keys, "_part"]).withColumn("_number", at)
    numbered = numbered.withColumn("key", F.when(F.col("_number") > 0, F.concat("key", F.lit(":"), F.col("_number").cast("string"))).otherwise(F.col("key")))
    return lone.select(*rows.columns).unionByName(numbered.select(*rows.columns))


def _rates(rows: DataFrame, weights: tuple, share: float, most: float, seed: str) -> DataFrame:
    """``rows(source, size, key, ...)`` with source_size, target and copies."""
    targets = source_targets(rows.select("source", "size"), weights, share, most).withColumnRenamed("source", "named")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return _drawing_apart(rows).join(targets, F.col("source").eqNullSafe(F.col("named"))).withColumn("copies", copies(rate, F.col("key"), seed))


def _key() -> Column:
    return F.concat(doc_key(), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def mix_plan(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken."""
    sized = docs.select("doc_id", "source", words().alias("size"), _key().alias("key"))
    return _rates(sized, weights, share, most, seed).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    # The row itself in one struct, so that no name of its own meets those added here.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), "source", words().alias("size"), _key().alias("key"))
    repeated = _rates(rows, weights, share, most, seed).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return repeated.select("doc.*")


SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS digest,
         row_number() OVER (PARTITION BY doc_id, md5(coalesce(text, '')), source ORDER BY doc_id) - 1 AS number FROM documents
), ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
         coalesce(sum(2.0::DOUBLE * source_size) OVER w, 0) AS most_before, coalesce(sum(weight) OVER w, 0) AS weight_before,
         sum(weight) OVER () AS all_weight, 1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM ranked
  WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), open AS (
  -- Sources fill up in the order of size by weight; the first that stays below its most sets the level.
  SELECT total - most_before AS rest, all_weight - weight_before AS weight_left
  FROM ordered WHERE weight * (total - most_before) / (all_weight - weight_before) < most
  ORDER BY source_size / weight, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size, coalesce(least(most, weight * rest / weight_left), most) AS target FROM ordered LEFT JOIN open ON true
), drawn AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || digest || CASE WHEN number > 0 THEN ':' || number::VARCHAR ELSE '' END), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS copies,
       (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS taken
FROM drawn
"""

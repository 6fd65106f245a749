"""Exact deduplication with disk-backed streaming state.

Texts are equal when identical after deleting the contract's white space; a null text is empty.
Of equal texts the row with the most code points in the original text, then the smallest doc_id,
stays (null ids last; then the first landed).

1. Arriving rows are landed in a folder under ``state_dir``: row number, id, length, digest (SHA-256
   of the normalised text) and the document itself. A row's locator is its landed file and number.
2. A Structured Streaming query over the landed files, in several batches, keeps for each digest and
   without expiry the row that stays (its stable identifier, the doc_id, and its content locator)
   and the number of rows. The state is in RocksDB: on the executors' disks, with changes
   checkpointed to the shared folder. Each batch writes the entries that it changed.
3. On hits, digests of more than one row that new rows came to, all texts of the new rows under the
   digest are compared in full with each other and with the stored row's, which is read back by its
   locator. A digest that turns out to have several texts is dealt with by text.

A later call with the same ``state_dir`` adds its rows to those already landed, and goes on from the
stored state: its result, over all rows landed so far, is that of a single call with all of them.
Each call is an arrival with a folder of its own, and a ledger says which arrivals are landed and which
are finished. A call that follows one that failed finishes what that one landed; if it brings the same
rows again (by their number and checksum, or under the same ``arrival`` name), they count once.
Without a ``state_dir`` each call has one of its own. Repeated rows count as rows and share an id: if
theirs is the id that stays, all of them are ``kept`` in ``exact_groups``, whose ``kept`` compares
ids. ``keep_one_copy`` keeps a single row of each group, with the columns of its input, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biorec.llm.common import few, materialize, new_path

#: State in RocksDB, with its changes in the shared folder; no space set aside for stores that hold little.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # All stores of an executor together, whatever their number.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}
#: Batches that the files of one arrival are taken in.
BATCHES = 2
#: Up to so many hits of 16 bytes are broadcast.
MOST_HITS = 2_000_000
#: A digest with more than this share of all rows is hot: there are at most 1 / HOT of them.
HOT = 0.001
_LOCATOR = "struct<file:string,row:bigint>"
_BEST = f"struct<minus_points:int,no_id:boolean,doc_id:bigint,locator:{_LOCATOR}>"
_CHANGES = f"digest string, best {_BEST}, n_rows bigint, batch bigint"


def normalised(column: str | Column = "text") -> Column:
    out = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
    for space in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _read(spark: SparkSession, schema, path: str) -> DataFrame:
    """The table at ``path``; without rows where nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _land(docs: DataFrame, digest: Callable[[Column], Column], folder: str) -> None:
    text = F.col("doc.text")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    rows.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc.doc_id").cast("long").alias("doc_id"), F.coalesce(F.char_length(text), F.lit(0)).alias("n_points"),
        digest(normalised(text)).alias("digest"), "doc",
    ).write.mode("overwrite").parquet(folder)


def _located(landed: DataFrame) -> DataFrame:
    """Landed rows with their locators."""
    return landed.select("*", F.struct(F.col("_metadata.file_path").alias("file"), "row").alias("locator"))


def _stayer() -> Column:
    """Most code points, then the smallest id; a null id loses."""
    return F.struct((-F.col("n_points")).alias("minus_points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")


def _stream(spark: SparkSession, folder: str, schema, state_dir: str, out: str) -> None:
    """Feed the files of an arrival that the state has not seen to it; what a batch changed goes to ``out``."""
    files = len(spark.read.schema(schema).parquet(folder).inputFiles())
    own = spark.newSession()  # settings of its own
    for k, v in (STATE | {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}).items():
        own.conf.set(k, v)
    parent, name = folder.rsplit("/", 1)
    # As a pattern, which has no base path: the files of earlier arrivals that the checkpoint names lie elsewhere.
    arrivals = own.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // BATCHES))).parquet(f"{parent}/{{{name}}}")
    arrivals = _located(arrivals).select("digest", "n_points", "doc_id", "locator")
    state = arrivals.groupBy("digest").agg(F.min(_stayer()).alias("best"), F.count(F.lit(1)).alias("n_rows"))
    # A batch that runs again overwrites what it wrote.
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    query = state.writeStream.outputMode("update").option("checkpointLocation", state_dir).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _latest(changes: DataFrame) -> DataFrame:
    last = changes.groupBy("digest").agg(F.max_by(F.struct("best", "n_rows"), "batch").alias("g"))
    return last.select("digest", "g.best", "g.n_rows")


def _clashing(spark: SparkSession, base: str, folder: str, schema, after: int) -> DataFrame:
    """The digests under which an arrival's texts differ from each other or from the stored row's."""
    changes = _read(spark, _CHANGES, f"{base}/groups")
    hits = materialize(_latest(changes.where(F.col("batch") > after)).where("n_rows > 1").select("digest", F.xxhash64("digest").alias("h")), "hits")
    stored = materialize(_latest(changes.where(F.col("batch") <= after)).join(hits, "digest", "left_semi").select("best.locator"), "stored")
    # 64-bit hashes keep the texts of other digests out of the shuffle; equality is of digests and whole bytes.
    own = _located(_read(spark, schema, folder)).withColumn("h", F.xxhash64("digest")).join(few(hits.select("h"), MOST_HITS), "h", "left_semi")
    texts = own.select("digest", normalised(F.col("doc.text")).alias("norm"))
    # Of earlier arrivals only the files that hold a stored row are read.
    files = [r["file"] for r in stored.select("locator.file").distinct().collect()]
    if files:
        back = _located(spark.read.schema(schema).parquet(*files)).join(few(stored), "locator", "left_semi")
        texts = texts.unionByName(back.select("digest", normalised(F.col("doc.text")).alias("norm")))
    # Partial aggregates leave a task's equal texts as one row, however many copies there are.
    each = texts.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts"))
    return each.where("n_texts > 1").select("digest")


def _same_rows(docs: DataFrame, landed: DataFrame) -> bool:
    """Do these tables have the same rows, by number and checksum?"""
    of = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)"))).first()
    other = landed.select("doc.*")
    return docs.columns == other.columns and of(docs) == of(other)


def _arrive(docs: DataFrame, digest: Callable[[Column], Column], base: str, arrival: str | None) -> None:
    """Take the rows of ``docs`` in as one arrival, whatever step an earlier call failed at."""
    if arrival is not None and not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9-]*", arrival):
        raise ValueError("an arrival's name has letters, digits and hyphens")
    spark = docs.sparkSession
    ledger: dict[str, dict[str, int]] = {}
    # A row for each arrival and event.
    for r in _read(spark, "arrival string, event string, after bigint", f"{base}/ledger").collect():
        ledger.setdefault(r["arrival"], {})[r["event"]] = r["after"]
    folder = lambda name: f"{base}/landed/{name}"
    note = lambda name, event, after: spark.createDataFrame([(name, event, after)], "arrival string, event string, after bigint").coalesce(1).write.mode("append").parquet(f"{base}/ledger")

    def finish(name: str) -> None:
        schema = spark.read.parquet(folder(name)).schema
        _stream(spark, folder(name), schema, f"{base}/state", f"{base}/groups")
        _clashing(spark, base, folder(name), schema, ledger[name]["landed"]).write.mode("overwrite").parquet(f"{base}/split/{name}")
        note(name, "finished", 0)

    for name, events in ledger.items():
        if "finished" not in events:
            if arrival is None and _same_rows(docs, spark.read.parquet(folder(name))):
                arrival = name
            finish(name)
            events["finished"] = 0
    name = arrival or uuid.uuid4().hex
    if name not in ledger:
        _land(docs, digest, folder(name))
        after = _read(spark, _CHANGES, f"{base}/groups").agg(F.max("batch")).first()[0]
        ledger[name] = {"landed": -1 if after is None else after}
        note(name, "landed", ledger[name]["landed"])
        finish(name)


def _all_landed(spark: SparkSession, base: str) -> DataFrame:
    folder = f"{base}/landed/*"
    return _located(spark.read.schema(spark.read.parquet(folder).schema).parquet(folder))


def _groups(docs: DataFrame, digest: Callable[[Column], Column], state_dir: str | None, arrival: str | None) -> DataFrame:
    """Every landed row with its group: landed columns, best, n_rows."""
    spark = docs.sparkSession
    base = state_dir or new_path(spark, "dedup")
    _arrive(docs, digest, base, arrival)
    landed = _all_landed(spark, base)
    groups = materialize(_latest(_read(spark, _CHANGES, f"{base}/groups")), "groups")
    split = _read(spark, "digest string", f"{base}/split/*").distinct()

    # Few digests can be hot: they go to the rows, so that no task gets all rows of one.
    total = groups.agg(F.sum("n_rows")).first()[0] or 0
    hot = groups.where(F.col("n_rows") > total * HOT).select("digest", "best", "n_rows")
    rows = landed.drop("doc")
    lone = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(groups.join(hot, "digest", "left_anti"), "digest")
    out = lone.unionByName(rows.join(F.broadcast(hot), "digest"))
    if split.limit(1).count():
        clashing = landed.join(split, "digest", "left_semi").withColumn("norm", normalised(F.col("doc.text")))
        each = clashing.groupBy("digest", "norm").agg(F.min(_stayer()).alias("best"), F.count(F.lit(1)).alias("n_rows"))
        apart = clashing.select("digest", "norm", *[c for c in rows.columns if c != "digest"]).join(each, ["digest", "norm"]).drop("norm")
        out = out.join(split, "digest", "left_anti").unionByName(apart)
    return out


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, state_dir: str | None = None, arrival: str | None = None) -> DataFrame:
    """One row per landed row: doc_id, keep_id, group_size, kept, text_sha256 (the digest), locator (of the row that stays)."""
    keep = F.col("best.doc_id")
    return _groups(docs, digest, state_dir, arrival).select(
        "doc_id", keep.alias("keep_id"), F.col("n_rows").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("digest").alias("text_sha256"), F.col("best.locator").alias("locator")
    )


def keep_one_copy(docs: DataFrame, digest: Callable[[Column], Column] = sha256, state_dir: str | None = None, arrival: str | None = None) -> DataFrame:
    """One landed row for each text, with the columns of ``docs``: the longest original, then the smallest id."""
    spark = docs.sparkSession
    base = state_dir or new_path(spark, "dedup")
    groups = _groups(docs, digest, base, arrival)
    dropped = materialize(groups.where("locator != best.locator").select("locator"), "dropped")
    return _all_landed(spark, base).join(few(dropped), "locator", "left_anti").select("doc.*")


SQL = """
WITH t AS (
  SELECT doc_id, coalesce(length(text), 0) AS n_points, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST) AS kept, text_sha256
FROM t
"""

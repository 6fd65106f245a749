"""Incremental ingest: entities in the order of their dependencies, and occurrence records in batches or from a stream of landed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from biorec.functions.tables import passing, read_buckets, read_if_any, read_version, remove, touched, write_buckets, write_version
from biorec.operators import geo, merge
from biorec.sources import records

Tables = dict[str, DataFrame]
#: What must be complete before an entity is taken in.
NEEDS = {
    "taxon_groups": (), "recording_schemes": (), "taxon_ranks": (), "geographic_regions": (), "grid_square_stats": ("geographic_regions",),
    "taxa": ("recording_schemes", "geographic_regions", "taxon_groups", "taxon_ranks"), "taxon_names": ("taxa",),
}


def ordered(entities: set[str]) -> list[str]:
    """These entities, each after those that it needs."""
    out: list[str] = []
    while len(out) < len(entities):
        ready = [e for e in NEEDS if e in entities and e not in out and not set(NEEDS[e]) & (entities - set(out))]
        if not ready:
            raise ValueError(f"unknown entities {sorted(entities - set(NEEDS))}")
        out += ready
    return out


def ingest_entities(root: str, reports: dict[str, DataFrame], tables: Tables, location_type: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Upsert report rows (with an ``order``) of several entities into the table versions under ``root``.

    An entity whose needs are neither among the reports nor stored is an error. ``tables`` gives the
    tables to start from. Returns counts (entity, action, n) and each entity's rejected rows.
    """
    spark = next(iter(tables.values())).sparkSession
    now = lambda name: found if (found := read_version(spark, f"{root}/{name}")) is not None else tables[name]
    counts, rejects = [], {}
    for entity in ordered(set(reports)):
        for need in NEEDS[entity]:
            if need not in reports and not now(need).limit(1).count():
                raise ValueError(f"{entity} needs {need} first")
        rows, existing = records.normalize(reports[entity], entity, location_type), now(entity)
        if entity == "taxa":
            merged, bad = merge.upsert_taxa(existing, rows, now("taxon_groups"), now("recording_schemes"), now("taxon_ranks"))
        elif entity == "taxon_names":
            merged, bad = merge.upsert_taxon_names(existing, rows, now("taxa"))
        elif entity == "grid_square_stats":
            merged, bad = merge.upsert_grid_squares(existing, rows, now("geographic_regions"))
        elif entity == "geographic_regions":
            merged, bad = merge.upsert_regions(existing, rows, tables["data_sources"])
        else:
            merged, bad = getattr(merge, f"upsert_{entity}")(existing, rows)
        written = spark.read.parquet(write_version(merged, f"{root}/merged/{entity}"))
        rejects[entity] = bad
        write_version(written.drop("action"), f"{root}/{entity}")
        counts.append(written.groupBy("action").agg(F.count(F.lit(1)).alias("n")).select(F.lit(entity).alias("entity"), "action", "n"))
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return total, rejects


#: Buckets of the stored records and of their region links. Fixed once a store has been written.
BUCKETS = 64
KEYS = {"occurrences": "unique_key", "geographic_regions_occurrences": "occurrence_id"}
#: What a batch did with its records: ``skipped`` and ``errors`` are rejected ones, and all but errors count as processed.
RUN = "number int, name string, fetched long, processed long, inserted long, updated long, unchanged long, skipped long, errors long"
#: What the ledger says of the last batch: its run, the paths that it staged, the store's layout, and whether the buckets have been replaced.
LEDGER = RUN + ", merged string, links string, rejects string, buckets int, top long, applied boolean"


def stored(spark: SparkSession, root: str, table: str, which: list[int] | None = None) -> DataFrame | None:
    """Stored records or region links; None before the first batch."""
    return read_buckets(spark, f"{root}/{table}", KEYS[table], which)


def _apply(spark: SparkSession, root: str, last: Row) -> None:
    """Replace the buckets that a staged batch touched. Doing so again gives the same."""
    for table, path, drop in (("geographic_regions_occurrences", last["links"], ()), ("occurrences", last["merged"], ("action",))):
        rows = spark.read.parquet(path)
        which = [r["_bucket"] for r in spark.read.parquet(f"{path}-buckets").collect()]
        write_buckets(rows.drop(*drop), f"{root}/{table}", KEYS[table], last["buckets"], which)
    run = [f.split()[0] for f in RUN.split(", ")]
    spark.createDataFrame([tuple(last[f] for f in run)], RUN).write.mode("overwrite").parquet(f"{root}/runs/batch={last['number']}")
    write_version(spark.createDataFrame([last.asDict() | {"applied": True}], LEDGER), f"{root}/ledger")
    # From here on the store has it all; the ledger names the rejects alone to readers.
    for path in (last["merged"], last["links"]):
        remove(spark, path)
        remove(spark, f"{path}-buckets")


def runs(spark: SparkSession, root: str) -> DataFrame | None:
    """A row for each batch, by number: what it fetched, processed, inserted, updated, left unchanged, skipped and failed on."""
    found = read_if_any(spark, f"{root}/runs/*")
    return found if found is None else found.orderBy("number")


def _observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """``df`` whose next write also counts."""
    seen = Observation()
    return df.observe(seen, *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()]), seen


def _stage(df: DataFrame, root: str, name: str, which: list[int]) -> str:
    path = write_version(df, f"{root}/staged/{name}")
    df.sparkSession.createDataFrame([(b,) for b in which], "_bucket int").write.mode("overwrite").parquet(f"{path}-buckets")
    return path


def ingest_batch(root: str, batch: DataFrame, tables: Tables, abbr: str, data_source_id: int, name: str | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Upsert normalised records into the store under ``root``; (counts by action, rejected rows).

    Records are stored in buckets of their unique_key, region links in buckets of the record. Only
    the buckets of the batch's keys are read, merged and replaced, so a small batch costs in
    proportion to them and not to the table. Regions are assigned anew for all records of the batch,
    changed or not.

    What a batch replaces is staged first, with the ids that it gives out. From then on it takes
    effect: whatever step fails, the next call replaces the buckets by what was staged, before anything
    else. A batch that comes again under the name of the last one is not merged again.
    """
    spark = batch.sparkSession
    ledger = read_version(spark, f"{root}/ledger")
    last = ledger.first() if ledger is not None else None
    if last is not None and not last["applied"]:
        _apply(spark, root, last)
    if last is None or name is None or name != last["name"]:
        buckets = last["buckets"] if last is not None else buckets
        keyed, fetched = _observed(merge.keyed_occurrences(batch, tables["taxa"], tables["taxon_names"], abbr), fetched=F.lit(True))
        keyed_path = write_version(keyed, f"{root}/staged/keyed")
        keyed = spark.read.parquet(keyed_path)
        which = touched(keyed.where("unique_key is not null"), "unique_key", buckets)
        before = stored(spark, root, "occurrences", which)
        existing = before if before is not None else tables["occurrences"].limit(0)
        top = last["top"] if last is not None else 0
        with passing(spark):
            merged, rejects = merge.merge_occurrences(existing, keyed, data_source_id, top=top)
            merged, done = _observed(merged, **{a: F.col("action") == a for a in ("inserted", "updated", "unchanged")})
            merged_path = _stage(merged, root, "occurrences", which)
        written = spark.read.parquet(merged_path)
        of_batch = written.where("action != 'kept'")
        changed = of_batch.select(F.col("id").alias("occurrence_id"))
        of_links = touched(changed, "occurrence_id", buckets)
        links = stored(spark, root, "geographic_regions_occurrences", of_links)
        if links is None:
            links = spark.createDataFrame([], "geographic_region_id long, occurrence_id long")
        links_path = _stage(geo.reassign_regions(links, of_batch.drop("action"), tables["geographic_regions"], changed), root, "links", of_links)
        failed = F.col("reason").startswith("error:")
        rejects, refused = _observed(rejects, skipped=~failed, errors=failed)
        rejects_path = write_version(rejects, f"{root}/staged/rejects")
        remove(spark, keyed_path)
        counts = fetched.get | done.get | refused.get
        run = {"number": last["number"] + 1 if last is not None else 0, "name": name, **counts, "processed": counts["fetched"] - counts["errors"]}
        paths = {"merged": merged_path, "links": links_path, "rejects": rejects_path, "buckets": buckets, "top": max(top, merge.largest_id(written)), "applied": False}
        staged = spark.createDataFrame([run | paths], LEDGER)
        write_version(staged, f"{root}/ledger")
        last = staged.first()
        _apply(spark, root, last)
    counts = [(a, last[a]) for a in ("inserted", "updated", "unchanged") if last[a]]
    return spark.createDataFrame(counts, "action string, n long"), spark.read.parquet(last["rejects"])


def checkpoints(batch: DataFrame, source_key: str, before: DataFrame | None = None) -> DataFrame:
    """(source_key, checkpoint): the largest tracking value of a source's records so far, as text.

    Numbers are compared as numbers. An empty batch leaves the checkpoint as it was.
    """
    numeric = dict(batch.dtypes)["tracking"] in ("int", "bigint")
    new = batch.agg(F.max("tracking").alias("v")).where("v is not null").select(F.lit(source_key).alias("source_key"), F.col("v").cast("string").alias("checkpoint"))
    every = new if before is None else new.unionByName(before.select("source_key", "checkpoint"))
    rank = F.when(F.col("source_key") == source_key, F.col("checkpoint").try_cast("bigint") if numeric else F.lit(None).cast("bigint"))
    return every.groupBy("source_key").agg(F.max_by("checkpoint", F.struct(rank.alias("n"), "checkpoint")).alias("checkpoint"))


def ingest_stream(spark: SparkSession, landing: str, normalize: Callable[[DataFrame], DataFrame], root: str, tables: Tables, abbr: str, data_source_id: int, checkpoint: str) -> None:
    """Take all landed pages that are new since the last run. The stream's checkpoint replaces a table of offsets.

    ``normalize`` makes records of payloads ``(value)``. Each batch's rejected rows go to ``rejects`` under ``root``.
    """

    def take(payloads: DataFrame, number: int) -> None:
        _, bad = ingest_batch(root, normalize(payloads), tables, abbr, data_source_id, f"{checkpoint}#{number}")
        bad.select("reason", F.to_json(F.struct("remote_id", "scientific_name_identifier", "given_name_identifier")).alias("record")).write.mode("overwrite").parquet(f"{root}/rejects/batch={number}")

    stream = spark.readStream.option("wholetext", True).text(landing)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()

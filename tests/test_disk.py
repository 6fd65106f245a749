"""What is left on disk: shuffles go with the write that made them, and a batch leaves its store, its ledger and its rejects alone."""

import pathlib

from pyspark.sql import functions as F

from biorec.functions import tables
from biorec.operators import merge, stats
from biorec.streaming import ingest
from tests.test_upserts import nbn, payload, world


def shuffles(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").splitlines()
    return {f.rsplit("/", 1)[-1] for f in found if f.rsplit("/", 1)[-1].startswith("shuffle")}


def test_shuffles_end_with_their_write(spark, tmp_path):
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    before = shuffles(spark)
    laid = tables.as_files(rows)
    tables.write_version(rows, str(tmp_path / "t"))
    assert not shuffles(spark) - before and sorted(map(tuple, laid.collect())) == sorted(map(tuple, rows.collect()))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    with tables.passing(spark):
        path = pathlib.Path(tables.as_files(rows).inputFiles()[0].removeprefix("file://")).parent
        assert path.exists()
    assert not path.exists()


def test_a_batch_leaves_its_store_alone(spark, tmp_path):
    root, t = str(tmp_path / "db"), world(spark)
    shared = pathlib.Path(tables.shared_folder(spark).removeprefix("file:"))
    before = set(shared.glob("files-*"))
    for batch in (payload(spark, *map(nbn, range(9))), payload(spark, *map(nbn, range(5, 20)))):
        counts, bad = ingest.ingest_batch(root, batch, t, "NBN", 1)
    assert set(shared.glob("files-*")) == before
    left = {str(p.parent.relative_to(tmp_path / "db" / "staged")).split("/")[0] for p in (tmp_path / "db" / "staged").rglob("*.parquet")}
    assert left == {"rejects"} and bad.count() == 0 and ingest.stored(spark, root, "occurrences").count() == 20


def test_records_are_dealt_out_once_for_both_lookups(spark):
    """Taxa and accepted names are met by the same key, and so after one exchange of the records."""
    taxa = spark.createDataFrame([(1, "S1", 7)], "id long, scientific_name_identifier string, species_id long")
    names = spark.createDataFrame([(3, "S1")], "id long, given_name_identifier string")
    rows = spark.createDataFrame([("S1", "G", "a")], "scientific_name_identifier string, given_name_identifier string, remark string")
    plan = merge.resolve_taxon_name(merge.resolve_taxon(rows, taxa), names)._jdf.queryExecution().executedPlan().toString()
    # Records by taxon and by given name; taxa; names for each of their two joins.
    assert plan.count("Exchange hashpartitioning") == 5


def test_taxon_stats_lay_records_down(spark):
    """The exchanges that join records, taxa and regions are over before the one by taxon begins."""
    occ = spark.createDataFrame([(1, 1, 5, 6, None, "SU01A", "A", "V", 0, None)], "id long, taxon_id long, family_id long, species_id long, from_date date, grid_ref_2km string, recorded_by string, identification_verification_status string, blocked int, deleted_at timestamp").withColumns({"from_date": F.lit("2020-01-01").cast("date"), "to_date": F.lit(None).cast("date")})
    taxa = spark.createDataFrame([(1, 3, 6, 5, 0, None)], "id long, taxon_rank_id long, species_id long, family_id long, blocked int, deleted_at timestamp")
    out = stats.taxon_stats(occ, taxa, spark.createDataFrame([(3, 1)], "id long, is_reporting int"), spark.createDataFrame([(11, 1)], "geographic_region_id long, occurrence_id long"), ("Family", "Species"))
    assert sorted((r["taxon_id"], r["geographic_region_id"] or 0, r["occurrences_count"]) for r in out.collect()) == [(5, 0, 1), (5, 11, 1), (6, 0, 1), (6, 11, 1)]
    assert "SortMergeJoin" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "occurrence_id" not in "".join(line for line in plan.splitlines() if "Join [" in line)


def test_taxa_of_statistics_are_not_broadcast(spark, monkeypatch):
    """Neither the taxa that records refer to nor those that statistics are of pass through the driver, however small their files are."""
    import __spark_entry__ as contract

    monkeypatch.setattr(stats, "as_files", lambda df: df)
    plan = contract.queries()["q4_taxon_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [taxon_id" in line]
    # The broadcast one is with the few taxa above others.
    assert sum("SortMergeJoin" in j for j in joins) == 2 and all("LeftOuter" in j for j in joins if "BroadcastHashJoin" in j)


def test_records_are_laid_down_with_small_broadcasts(spark, monkeypatch):
    """A table whose files are small may be large in the driver: while links and records are made, the session's threshold is lowered, and never raised."""
    import __spark_entry__ as contract

    name, seen = "spark.sql.autoBroadcastJoinThreshold", []
    monkeypatch.setattr(stats, "as_files", lambda df: (seen.append(spark.conf.get(name)), df)[1])
    before = spark.conf.get(name)
    contract.queries()["a2_taxon_stats"](spark, "/root/testdata/sf0.001")
    assert seen == [str(tables.MOST_BROADCAST)] * 2 and spark.conf.get(name) == before
    try:
        for low in ("-1", "1000", "1000b"):
            spark.conf.set(name, low)
            with tables.small_broadcasts(spark):
                assert spark.conf.get(name) in (low, low.removesuffix("b"))
    finally:
        spark.conf.set(name, before)

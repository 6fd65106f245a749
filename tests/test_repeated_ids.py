"""Tables so large that keys of parts reach the ids of families: each query against its SQL where taxa, and so records, repeat ids."""

import collections
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract

SOURCE = "/root/testdata/sf0.001"
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SHIFTS = {"p_partkey": 999_900, "l_partkey": 999_900, "s_suppkey": 10, "l_suppkey": 10, "c_custkey": 150, "o_custkey": 150, "o_orderkey": 1500, "l_orderkey": 1500, "event_id": 1000, "user_id": 15}


@pytest.fixture(scope="module")
def doubled(spark, tmp_path_factory):
    """sf0.001 and a copy of it with shifted keys; the keys of the copied parts end beyond a million."""
    root = str(tmp_path_factory.mktemp("doubled"))
    for name in NAMES:
        df = spark.read.parquet(f"{SOURCE}/{name}.parquet")
        if name not in ("region", "nation"):
            df = df.unionByName(df.withColumns({c: (F.col(c) + n).cast(df.schema[c].dataType) for c, n in SHIFTS.items() if c in df.columns}))
        df.coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return root


def plain(value):
    return round(float(value), 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", [
    "l4_taxon_labels",
    "q2_taxa",
    "a3_taxon_year_stats",
    "e4_grid_squares",
    "e5_occurrence_regions",
    "g2_assign_regions",
    "g3_reassign_regions",
    "q3_taxon_names",
    "q4_taxon_stats",
    "q5_taxon_year_stats",
    "r8_all_reasons",
    "r8_occurrence_rejects",
    "u12_moderate",
    "n2_normalize_indicia",
    "o3_total",
    "p1_taxa_report",
    "p3_higher_taxa",
    "q1_occurrences_in_region",
    #END
])
def test_agrees_with_its_sql(spark, doubled, name):
    df = contract.queries()[name](spark, doubled)
    columns = sorted(df.columns)
    ours = collections.Counter(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    engine = duckdb.connect()
    for table in NAMES:
        files = [f"{doubled}/{table}.parquet/{f}" for f in os.listdir(f"{doubled}/{table}.parquet") if f.endswith(".parquet")]
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet({files})")
    theirs = engine.execute(f"SELECT {', '.join(columns)} FROM ({contract.oracle_sql()[name]})").fetchall()
    assert ours == collections.Counter(tuple(plain(v) for v in r) for r in theirs)


def test_paths_of_repeated_ids(spark, doubled):
    """An id that rows share has one path, also on cycles; every row of the id is kept."""
    from biorec.operators import taxonomy

    n = 24
    rows = [(i, i % n + 1) for i in range(1, n + 1)] + [(i, None) for i in range(1, n + 1)] + [(100, 1)]
    df = spark.createDataFrame(rows, "id long, parent_taxon_id long")
    got = collections.Counter((r["id"], tuple(r["path"])) for r in taxonomy.with_paths(df).collect())
    walk = lambda i: tuple((i + k - 1) % n + 1 for k in range(n - 1, -1, -1))
    assert got == collections.Counter([(i, walk(i)) for i in range(1, n + 1)] * 2 + [(100, (*walk(1), 100))])
    names = contract.queries()["p3_names_by_parents"](spark, doubled)
    assert names.count() == names.select("id").distinct().count()


def test_taxa_are_not_broadcast(spark):
    """However small the files of the taxa are, neither they nor what is collected from them passes through the driver."""
    plan = contract.queries()["q2_taxa"](spark, SOURCE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin [") == 3  # parents, ranks' taxa, and their lists
    assert all("taxon_rank" in line for line in plan.splitlines() if "BroadcastHashJoin [" in line)

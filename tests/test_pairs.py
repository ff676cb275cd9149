"""Whole complements and matrices of paired data."""

from __future__ import annotations

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from evoframe.functions.hashing import permuted, ranked_within, summed_before
from evoframe.operators import pairs
from evoframe.plans.catalogue import ORACLES, QUERIES

KNOWN = {(d, t) for d in range(9) for t in range(0, 400, 7) if (d * t) % 5 < 2}


def held(spark):
    rows = sorted(KNOWN) * 2
    return spark.createDataFrame(rows, "d long, t long")


def test_every_cell_is_there(spark):
    drugs, targets = ({p[k] for p in KNOWN} for k in (0, 1))
    found = Counter(tuple(r) for r in pairs.cells(held(spark), "d", "t").collect())
    assert found == Counter((d, t, int((d, t) in KNOWN)) for d in drugs for t in targets)


def test_matrix_query_has_all_parts(spark, tmp_path):
    rows = [(1, 1, d, t) for d, t in sorted(KNOWN)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["interaction_matrix_whole"](spark, str(tmp_path)).collect()
    assert {r.l_partkey for r in found} == {t for _, t in KNOWN}
    assert len(found) == len({d for d, _ in KNOWN}) * len({t for _, t in KNOWN}) and sum(r.cell for r in found) == len(KNOWN)


def test_negatives_come_from_the_whole_complement_without_a_cross_join(spark):
    made = pairs.with_negatives(held(spark), "d", "t", 100.0)
    assert "CartesianProduct" not in (plan := made._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    found = Counter(tuple(r) for r in made.collect())
    assert found == Counter((d, t, int((d, t) in KNOWN)) for d in {d for d, _ in KNOWN} for t in {t for _, t in KNOWN})


def test_unknown_pairs_are_all_or_an_exact_sample(spark):
    known = {(f"d{i}", f"t{j}") for i in range(12) for j in range(40) if i == 3 or (i * 7 + j * j) % 11 == 0 or j < 12}  # d3 knows all
    rows = spark.createDataFrame(sorted(known), "drug string, target string").repartition(3)
    others = {(f"d{i}", f"t{j}") for i in range(12) for j in range(40)} - known
    for wanted in (0, 1, 57, len(others), 10**6):
        found = [tuple(r) for r in pairs.unknown_pairs(rows, "drug", "target", wanted, 3).collect()]
        assert len(found) == len(set(found)) == min(wanted, len(others)) and set(found) <= others
    one, two = ({tuple(r) for r in pairs.unknown_pairs(rows, "drug", "target", 60, s).collect()} for s in (1, 2))
    assert one != two
    assert pairs.unknown_pairs(spark.createDataFrame([], "drug string, target string"), "drug", "target", 5).count() == 0
    whole = spark.createDataFrame([(i, j) for i in range(3) for j in range(4)], "drug long, target long")
    assert pairs.with_negatives(whole, "drug", "target").where("label = 0").count() == 0
    doubled = whole.where("drug <> 1 OR target <> 2").union(whole.where("drug = 0")).union(spark.createDataFrame([(None, 1), (1, None)], "drug long, target long"))
    found = pairs.with_negatives(doubled, "drug", "target", 1.0).collect()
    assert sorted(tuple(r) for r in found if r.label == 0) == [(1, 2, 0)] and len(found) == 12


def test_draws_are_distinct_and_spread(spark):
    for size in (1, 2, 3, 10, 97, 1000):
        found = [r[0] for r in spark.range(size).select(permuted(F.col("id"), size, 5)).collect()]
        assert sorted(found) == list(range(size))
    large = 10**13 + 7
    found = [r[0] for r in spark.range(20_000).select(permuted(F.col("id"), large, 5)).collect()]
    assert len(set(found)) == 20_000 and 0 <= min(found) and max(found) < large
    tenths = [sum(1 for v in found if v * 10 // large == k) for k in range(10)]
    assert max(tenths) < 2200 and min(tenths) > 1800


def test_ranks_and_sums_over_ranges(spark):
    rows = [(g, o, t) for g in ("a", "b", None) for o in range(30) for t in range(1 + o % 3)]
    df = spark.createDataFrame(rows, "g string, o long, t long").repartition(4)
    found = {(r.g, r.o, r.t): r.n for r in ranked_within(df, "g", "o", "n", "t", parts=7).collect()}
    for g in ("a", "b", None):
        own = sorted((o, t) for gg, o, t in rows if gg == g)
        assert [found[(g, o, t)] for o, t in own] == list(range(len(own)))
    single = spark.createDataFrame([(i, i * i % 5) for i in range(50)], "o long, v long")
    found = {r.o: r.s for r in summed_before(single, "o", "v", "s", parts=6).collect()}
    assert found == {i: sum(k * k % 5 for k in range(i)) for i in range(50)}


def test_cells_are_not_shuffled(spark):
    rows = [(i % 30, i * 7 % 50) for i in range(200)] + [(None, 1), (2, None), (2, 2)]
    pairs_ = spark.createDataFrame(rows, "d long, t long")
    known = {(d, t) for d, t in rows if d is not None and t is not None}
    for together in (4, 1000):
        found = pairs.cells(pairs_, "d", "t", together)
        assert Counter(tuple(r) for r in found.collect()) == Counter((d, t, int((d, t) in known)) for d in [*range(30), None] for t in [*range(50), None])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more pairs than a broadcast takes
    try:
        plan = pairs.cells(pairs_, "d", "t")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    assert not any("Join" in line for line in lines[: next(i for i, line in enumerate(lines) if "Generate" in line)])  # nothing is joined after the cells are made


def test_cells_are_bits_of_words_and_tasks_are_about_equal(spark):
    known = {(d, t) for d in range(200) for t in range(300) if d in (0, 63, 64, 199) or d * t % 7 == 1 or t == 5}
    made = pairs.cells(spark.createDataFrame(sorted(known) * 2, "d long, t long").repartition(3), "d", "t", 130)  # words of 64 and shorter ones
    assert Counter(tuple(r) for r in made.collect()) == Counter((d, t, int((d, t) in known)) for d in range(200) for t in range(300))
    assert "array_contains" not in made._jdf.queryExecution().optimizedPlan().toString()  # nothing is searched for a cell, however many are known
    for together in (130, 4096):
        sizes = pairs.cells(spark.createDataFrame(sorted(known), "d long, t long"), "d", "t", together).groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 2 * 200 * 300 / 4, [r["count"] for r in sizes]


def test_matrix_queries_follow_their_sql_and_deal_cells_evenly(spark, tmp_path):
    known = [(d, t) for d in range(150) for t in range(90) if d * t % 11 == 3 or d % 64 == 63] + [(None, 1), (2, None), (None, None)]
    spark.createDataFrame([(1, 1, d, t) for d, t in known * 2], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("interaction_matrix", "interaction_matrix_whole"):
        made = QUERIES[name](spark, str(tmp_path))
        assert Counter(tuple(r) for r in made.select("l_suppkey", "l_partkey", "cell").collect()) == Counter(con.sql(f"SELECT l_suppkey, l_partkey, cell FROM ({ORACLES[name]})").fetchall())
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * 151 * 91 / 4, sizes

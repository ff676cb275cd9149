"""Every registered query against its SQL at the smallest scale, and properties of the rest."""

from __future__ import annotations

import os

import duckdb
import pytest

from evoframe.plans.catalogue import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{file}'")
    return con


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    found = QUERIES[name](spark, SMALL)
    names = sorted(found.columns)
    rows = duck.sql(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in found.select(*names).collect()]
    assert len(got) == len(rows) > 0
    for a, b in zip(sorted(got, key=key), sorted(rows, key=key)):
        assert a == pytest.approx(b, abs=2e-6), name


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("search_") and n not in ORACLES))
def test_search_keeps_its_budget_and_is_repeatable(spark, name):
    one = sorted(QUERIES[name](spark, SMALL).collect())
    two = sorted(QUERIES[name](spark, SMALL).collect()) if name in ("search_grey_wolf", "search_particle_swarm") else one
    vectors = {r.run: r.n for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").selectExpr("vec_id div 32 AS run").groupBy("run").agg({"*": "count"}).toDF("run", "n").collect()}
    assert one == two and {r.run for r in one} == set(vectors)
    for r in one:
        assert r.evals == vectors[r.run] * (r.iters + 1) and (r.stopped_early and r.stalled == 3) or r.iters == 10


def test_steps_beat_random_search(spark):
    best = {n: max(r.best for r in QUERIES[f"search_{n}"](spark, SMALL).collect()) for n in ("random", "grey_wolf", "differential")}
    assert best["grey_wolf"] < best["random"] and best["differential"] < best["random"]


@pytest.mark.parametrize("how", ["mean", "median"])
def test_rows_of_one_number_give_way_to_the_first(spark, tmp_path, how):
    rows = "SELECT i // 40 AS l_orderkey, 1 AS l_linenumber, i % 4 AS l_partkey, 1.0::DOUBLE * i AS l_quantity, chr((65 + i * 7 % 26)::INTEGER) AS l_returnflag FROM range(400) t(i)"
    con = duckdb.connect()
    con.sql(rows).write_parquet(str(tmp_path / "lineitem.parquet"))
    con.execute(f"SET threads = 1; CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    found = QUERIES[f"collapse_{how}"](spark, str(tmp_path))
    assert {tuple(r) for r in found.select("l_partkey", "l_returnflag", "l_quantity").collect()} == set(con.sql(f"SELECT l_partkey, l_returnflag, l_quantity FROM ({ORACLES[f'collapse_{how}']})").fetchall())


@pytest.mark.parametrize("members", [1, 2])
def test_grey_wolves_of_a_run_with_few_members(spark, tmp_path, members):
    con = duckdb.connect()
    con.sql(f"SELECT i AS vec_id, list_transform(range(64), lambda j: ((i * 31 + j * 17) % 23 / 11.0 - 1)::FLOAT) AS embedding FROM range({32 + members}) t(i)").write_parquet(str(tmp_path / "embeddings.parquet"))
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = {(r.run, r.id, r.pos): r.value for r in QUERIES["grey_wolf_step"](spark, str(tmp_path)).collect()}
    want = {(run, i, pos): v for run, i, pos, v in con.sql(f"SELECT run, id, pos, value FROM ({ORACLES['grey_wolf_step']})").fetchall()}
    assert got == pytest.approx(want, abs=2e-6) and len(got) == 64 * (32 + members)
    assert QUERIES["search_grey_wolf"](spark, str(tmp_path)).count() == 2


@pytest.mark.parametrize("name", ["pareto_sort", "survivors", "knees"])
def test_populations_are_whole_nations(spark, duck, name):
    nations = {r[0] for r in duck.sql("SELECT DISTINCT c_nationkey FROM customer").fetchall()}
    assert {r.run for r in QUERIES[name](spark, SMALL).collect()} == nations and len(nations) > 20

"""Operators that the catalogue does not show whole: edge cases, readers and the stream."""

from __future__ import annotations

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoframe.functions import metrics, sequences
from evoframe.functions.hashing import range_of, share
from evoframe.operators import clean, objectives, pareto, search
from evoframe.operators.budget import Budget
from evoframe.sources import readers
from evoframe.streaming.archive import keep_front


def test_auc_of_over_a_million_scores(spark):
    rows = spark.range(1_200_000).select((F.pmod(F.xxhash64("id"), F.lit(5)) < F.col("id") / 400_000).cast("int").alias("y"), F.col("id").alias("s"))
    n1, ranks = rows.where("y = 1").agg(F.count("*"), F.sum(F.col("s") + 1)).first()
    expected = (ranks - n1 * (n1 + 1) / 2) / (n1 * (1_200_000 - n1))
    assert metrics.auc(rows, "y", "s").first()[0] == pytest.approx(expected, abs=1e-12)


def test_front_of_many_points(spark):
    points = spark.range(1_100_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1 << 40))).alias("f1"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 40))).alias("f2"))
    found = {r.id for r in pareto.front_of_two(points, "f1", "f2", "id").collect()}
    assert found == {r.id for r in pareto.front(points, ["f1", "f2"], "id").collect()} and len(found) > 3


def test_thresholds_and_shares(spark):
    rows = spark.createDataFrame([(float("nan"),), (None,), (5.0,), (6.5,)], "v double")
    assert [r[0] for r in rows.select(clean.above(F.col("v"), 6.0)).collect()] == [0, 0, 0, 1]
    assert share(2, 0.9) == 1 and share(10, 0.25) == 2 and share(10, 0.01) == 1


def test_protein_features(spark):
    rows = spark.createDataFrame([(1, "KKDD"), (2, "AAAA"), (3, "ACXD-*"), (4, "123"), (5, None)], "id int, s string")
    found = {r.id: dict(zip(sequences.ctd_names(), r.features)) for r in sequences.featurized(rows, "s", "ctd").collect()}
    assert set(found) == {1, 2, 3}
    one = found[1]
    assert (one["charge_C1"], one["charge_C3"], one["charge_D1_0"], one["charge_D1_100"]) == (0.5, 0.5, 25.0, 50.0)
    assert one["charge_T13"] == pytest.approx(1 / 3) and found[2]["charge_C1"] == 0 and found[2]["charge_D1_50"] == 0
    with pytest.raises(Exception, match="residues"):
        sequences.featurized(rows, "s", "aac", "raise").collect()


def test_atoms(spark):
    row = spark.createDataFrame([("CC(=O)Cl[nH]Br%12@@?>Si",)], "s string").select(sequences.tokenize(F.col("s"), "atom")).first()
    assert row[0] == ["C", "C", "(", "=", "O", ")", "Cl", "[nH]", "Br", "%12", "@", "@", "?", ">", "S"]


def test_stalls_beyond_a_delta(spark):
    series = spark.createDataFrame([(1, i, v) for i, v in enumerate([10.0, 9.9, 9.8, 5.0, 5.0, 4.95, 1.0], 1)], "run int, iter long, best double")
    found = sorted((r.stall, r.length, r.tail) for r in clean.stalls_beyond(series, "run", 0.5).collect())
    assert found == [(0, 2, False), (1, 2, False), (2, 0, True)]


def test_undersampling_keeps_exactly(spark):
    bits = spark.range(3).withColumnRenamed("id", "cand_id").select("cand_id", F.explode(F.sequence(F.lit(0), F.lit(999))).alias("row_id"))
    bits = bits.withColumn("bit", (F.col("row_id") % (F.col("cand_id") + 2) == 0).cast("int"))
    found = objectives.undersample_repair(bits, 400).collect()
    for cand in range(3):
        own = [r for r in found if r.cand_id == cand]
        assert len(own) == len({r.row_id for r in own}) == 400
        assert sum(r.bit for r in own) == min(400, sum(k % (cand + 2) == 0 for k in range(1000)))
    assert objectives.kept_majority(10, 100, 1.5) == 15 and objectives.kept_majority(10, 5) == 5
    assert objectives.undersample_repair(bits, 5000).count() == 3000


def test_grasshoppers_find_the_middle(spark):
    start = search.initial(spark, 2, 30, 3, -5.12, 5.12, objectives.sphere)
    found = search.search(start.drop("f"), "grasshopper", objectives.sphere, -5.12, 5.12, Budget(max_evals=30 * 8))
    assert max(r.best for r in found.collect()) < max(r.best for r in start.groupBy("run").agg(F.min("f").alias("best")).collect())
    assert all(r.evals == 240 and r.iters == 7 for r in found.collect())


def test_series_matrix(spark, tmp_path):
    text = """!Series_title\t"x"
!Sample_characteristics_ch1\t"disease: UC"\t"disease: Normal"\t"disease: UC"
!Sample_characteristics_ch1\t"age: 40"\t"age: "\t"sex: M"
!Sample_characteristics_ch1\t"age: 41"\t"age: "\t"sex: M"
!series_matrix_table_begin
"ID_REF"\t"GSM1"\t"GSM2"\t"GSM3"
"p1"\t0.10\t0.20\t0.30
"p2"\t0.50\tnull\t0.70
"p3"\t\t\t9.00
"p4"\t\t\t
!series_matrix_table_end
"""
    path = tmp_path / "m.txt.gz"
    path.write_bytes(gzip.compress(text.encode()))
    values, meta = readers.series_matrix(spark, str(path))
    cells = {(r.sample_id, r.probe_id): r.value for r in values.collect()}
    assert len(cells) == 12 and cells["GSM2", "p2"] is None and cells["GSM3", "p3"] == 9.0
    assert {r.sample_id: r.meta for r in meta.collect()} == {"GSM1": {"disease": "UC", "age": "41"}, "GSM2": {"disease": "Normal", "age": None}, "GSM3": {"disease": "UC", "sex": "M"}}
    kept = clean.drop_missing(values, "probe_id", "value", 0.5)
    assert {r.probe_id for r in kept.collect()} == {"p1", "p2"}
    filled = {(r.sample_id, r.probe_id): r.value for r in clean.impute(values, "probe_id", "value").collect()}
    assert filled["GSM2", "p2"] == pytest.approx(0.6) and not any(p == "p4" for _, p in filled)


def test_pair_readers(spark, tmp_path):
    (tmp_path / "davis.tab").write_text("ID1\tX1\tID2\tX2\tY\nd1\tCCO\tt1\tMKV\t10\nd1\tCCO\tt2\tACDE\t10000\nd2\tc1ccccc1\tt1\tMKV\t100\n")
    assert [r.affinity for r in readers.drug_targets(spark, str(tmp_path / "davis.tab")).collect()] == pytest.approx([8, 5, 7])
    (tmp_path / "ddi.csv").write_text('ID1,ID2,Y,Map,X1,X2\nDB1,DB2,1,"type one",CCO,CCC\nDB3,DB1,2,"type two",CCN,CCO\n')
    assert readers.drug_drugs(spark, str(tmp_path / "ddi.csv")).count() == 2
    (tmp_path / "edges.tsv").write_text("hsa:1\tD001\nhsa:1\tD002\nhsa:2\tD001\n")
    assert {(r.drug_id, r.target_id) for r in readers.edges(spark, str(tmp_path / "edges.tsv")).collect()} == {("D001", "hsa:1"), ("D002", "hsa:1"), ("D001", "hsa:2")}
    (tmp_path / "tox21.csv").write_text("NR-AR,SR-p53,mol_id,smiles\n1,0,T1,CCO\n0,,T2,CC(=O)O\n,1,T3,c1ccccc1\n")
    rows, labels = readers.molecules(spark, str(tmp_path / "tox21.csv"), "tox21")
    assert labels == ["NR-AR", "SR-p53"] and clean.resolve_task(labels, "p53") == "SR-p53"
    found = clean.label_task(rows, "SR-p53", "smiles").collect()
    assert {(r.smiles, r.y) for r in found} == {("CCO", 0), ("c1ccccc1", 1)}
    for wanted in ("r", "NR-ER"):
        with pytest.raises(KeyError):
            clean.resolve_task(labels, wanted)


def test_archive_goes_on_after_a_restart(spark, tmp_path):
    def give(number, rows):
        spark.createDataFrame(rows, "id long, f1 double, f2 double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, f1 double, f2 double").parquet(str(tmp_path / "in"))
        query = keep_front(stream, str(tmp_path / "out"), "f1", "f2", "id", str(tmp_path / "ck"))
        query.processAllAvailable()
        query.stop()
        return {r.id for r in spark.read.parquet(f"{tmp_path}/out/{number:010d}").collect()}

    assert give(0, [(1, 1.0, 5.0), (2, 2.0, 2.0), (3, 3.0, 3.0)]) == {1, 2}
    assert give(1, [(4, 0.5, 6.0), (5, 2.0, 1.0)]) == {4, 1, 5}


def test_draws_of_populations(spark):
    from evoframe.operators import selection

    people = spark.createDataFrame([(0, i, float(i), 0.0) for i in range(5)] + [(1, 9, 1.0, 2.0)], "run long, id long, f double, weight double")
    drawn = selection.entrants(people, 40, 3, seed=1)
    assert drawn.count() == 2 * 40 * 3 and {r.id for r in drawn.where("run = 0").collect()} == set(range(5))
    assert all(r.id == 9 for r in selection.winners(people, drawn).where("run = 1").collect())
    draws = spark.createDataFrame([(0, k, k / 5) for k in range(5)] + [(1, 0, 0.999)], "run long, draw long, u double")
    found = {(r.run, r.draw): r.id for r in selection.roulette(people, draws).collect()}
    assert found == {(0, 0): 0, (0, 1): 1, (0, 2): 2, (0, 3): 3, (0, 4): 4, (1, 0): 9}  # without weights all have equal shares


def test_proposals_that_are_not_finite_are_refused(spark):
    from pyspark.sql import functions as F

    from evoframe.operators import objectives

    rows = spark.createDataFrame([(1.0, 0.5), (1.0, float("nan")), (1.0, float("inf")), (1.0, 1.5), (1.0, 9.0)], "f double, new double")
    found = [r[0] for r in rows.select(objectives.accepted(F.col("f"), F.col("new"), F.lit(1.0), F.lit(0.3))).collect()]
    assert found == [True, False, False, True, False]


@pytest.mark.parametrize("block", [10_000, 17])
def test_fronts_of_one_population(spark, block):
    draw = np.random.default_rng(8)
    values = draw.integers(0, 9, (150, 3)) / 8 + draw.choice([0.0, 1e-17, 0.1], (150, 3))
    rows = [(f"k{i}", *v.tolist(), 1) for i, v in enumerate(values)] + [("null", None, 1.0, 1.0, 1), ("nan", 1.0, float("nan"), 1.0, 1), ("twin", *values[3].tolist(), 1)]
    points = spark.createDataFrame(rows, "name string, a double, b double, c double, front int").repartition(3)
    values = np.vstack([values, values[3]])
    beats = (values[:, None] <= values[None]).all(axis=2) & (values[:, None] < values[None]).any(axis=2)
    number, left, n = {}, np.arange(151), 0
    while len(left):
        best = ~beats[np.ix_(left, left)].any(axis=0)
        number |= {int(i): n for i in left[best]}
        left, n = left[~best], n + 1
    wanted = {("twin" if i == 150 else f"k{i}"): n for i, n in number.items()}
    assert {r.name: r.front for r in pareto.fronts_of_all(points, ["a", "b", "c"], "name", block).collect()} == wanted
    assert pareto.fronts_of_all(points.limit(0), ["a", "b"], "name").count() == 0


def test_medians_by_counts(spark):
    draw = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in draw.integers(0, 40, 3001)] + [("even", float(v)) for v in draw.normal(size=80)] + [("one", 2.5), ("one", None), ("none", None), (None, 1.0), (None, 4.0)]
    found = {r.g: r.m for r in metrics.medians(spark.createDataFrame(rows, "g string, v double").repartition(3), "g", "v", "m").collect()}
    known = {g: [v for h, v in rows if h == g and v is not None] for g in ("hot", "even", "one", None)}
    assert found == {g: pytest.approx(float(np.median(v))) for g, v in known.items()}


@pytest.mark.parametrize("width", [1, 2, 3])
def test_fronts_of_populations_of_many_blocks(spark, width):
    rows = [(i % 2, i, float(i * 37 % 11), float(i * 53 % 13), float(i * i % 17)) for i in range(400)] + [(0, 400 + i, 3.0, 4.0, 5.0) for i in range(40)]
    points, names = spark.createDataFrame(rows, "run long, id long, f1 double, f2 double, f3 double"), ["f1", "f2", "f3"][:width]
    want = {(r.run, r.id): r.front for r in pareto.front_numbers(points, names, "id", "run").collect()}
    assert {(r.run, r.id): r.front for r in pareto.fronts_in_blocks(points, names, "id", "run", block=37).collect()} == want and len(set(want.values())) > 3
    with_nothing = points.unionByName(spark.createDataFrame([(5, 999, None, float("nan"), 1.0)], points.schema))
    assert {(r.run, r.id): r.front for r in pareto.fronts_in_blocks(with_nothing, names, "id", "run").collect()} == want | {(5, 999): 0}
    assert pareto.fronts_in_blocks(points.limit(0), names, "id", "run").count() == 0


def test_fronts_are_numbered_without_comparing_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pareto, "_fronts_by_comparing", None)  # its work grows with the square of the points
    points = spark.range(200_000).select("id", *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 40)).cast("double").alias(f"f{k}") for k in range(3)])
    found = pareto.fronts_of_all(points, ["f0", "f1", "f2"], "id")
    assert found.count() == 200_000 and found.agg(F.max("front")).first()[0] > 20


def test_ranges_of_values(spark):
    cuts = [0.5, 1.0, 2.5, 7.0]
    rows = spark.createDataFrame([(None,), (0.5,), (0.6,), (1.0,), (3.0,), (7.0,), (8.0,), (float("nan"),)], "v double")
    assert [r[0] for r in rows.select(range_of(F.col("v"), cuts)).collect()] == [0, 0, 1, 1, 3, 3, 4, 4] and [r[0] for r in rows.select(range_of(F.col("v"), [])).collect()] == [0] * 8

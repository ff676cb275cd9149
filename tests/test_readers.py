"""Readers of the data sets' files, problems and small encodings."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from evoframe.functions import sequences
from evoframe.operators import objectives, problem
from evoframe.sources import readers

TABLES = {
    "sider": ("smiles,Hepatobiliary disorders,Eye disorders\nCCO,1,0\nCCN,0,\n", ["Hepatobiliary disorders", "Eye disorders"]),
    "tox21": ("NR-AR,SR-p53,mol_id,smiles\n0,1,TOX1,CCO\n,0,TOX2,CCN\n", ["NR-AR", "SR-p53"]),
    "bbbp": ("num,name,p_np,smiles\n1,ethanol,1,CCO\n2,other,0,CCN\n", ["p_np"]),
    "clintox": ("smiles,FDA_APPROVED,CT_TOX\nCCO,1,0\nCCN,1,1\n", ["FDA_APPROVED", "CT_TOX"]),
    "hiv": ("smiles,activity,HIV_active\nCCO,CI,0\nCCN,CM,1\n", ["HIV_active"]),
}


@pytest.mark.parametrize("kind", sorted(TABLES))
def test_molecule_tables(spark, tmp_path, kind):
    text, wanted = TABLES[kind]
    path = tmp_path / f"{kind}.csv.gz"
    path.write_bytes(gzip.compress(text.encode()))
    rows, labels = readers.molecules(spark, str(path), kind)
    assert labels == wanted and rows.count() == 2
    assert all(t == "double" for c, t in rows.dtypes if c in labels) and {r.smiles for r in rows.collect()} == {"CCO", "CCN"}
    kept, again = readers.molecules(spark, str(path), kind, str(tmp_path / "kept"))
    assert again == wanted and readers.molecules(spark, "", kind, str(tmp_path / "kept"))[0].count() == kept.count() == 2
    with pytest.raises(ValueError, match="one of"):
        readers.molecules(spark, str(path), "qm9")
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="no column smiles"):
        readers.molecules(spark, str(bad), kind)


def test_pairs_and_their_columns(spark, tmp_path):
    dti, ddi = tmp_path / "dti.tab", tmp_path / "ddi.csv"
    dti.write_text("ID1\tX1\tID2\tX2\tY\nD1\tCCO\tT1\tMKV\t10\n")
    ddi.write_text("Y,ID1,ID2,Map,X1,X2,more\n5,A,B,#Drug1 lowers #Drug2,CCO,CCN,x\n")
    assert readers.arrays(readers.drug_targets(spark, str(dti)), "dti").collect() == [("CCO", "MKV", 8.0)]
    rows = readers.drug_drugs(spark, str(ddi))
    assert readers.arrays(rows, "ddi").collect() == [("CCO", "CCN", 5)] and "more" not in rows.columns
    for wrong in (lambda: readers.drug_targets(spark, str(ddi)), lambda: readers.drug_drugs(spark, str(dti)), lambda: readers.arrays(rows, "dti"), lambda: readers.arrays(rows, "dda")):
        with pytest.raises(ValueError):
            wrong()
    (tmp_path / readers.SUBSETS["gpcr"]).write_text("hsa:1\tD1\nhsa:2\tD1\n")
    assert readers.edges(spark, str(tmp_path), "gpcr").count() == 2
    with pytest.raises(ValueError, match="one of"):
        readers.edges(spark, str(tmp_path), "kinase")


def test_problems(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 9.0])], "id long, x array<double>")
    least = problem.Problem(objectives.sphere, 2, -5.0, 5.0)
    most = problem.Problem(objectives.sphere, 2, -5.0, 5.0, maximize=True)
    both = problem.Problem(lambda x: F.array(x[0], x[1]), 2, -5.0, 5.0, ("a", "b"))
    assert [r.f for r in least.evaluated(rows).orderBy("id").collect()] == [25.0, 81.0]
    assert [(r.f, r.g) for r in most.evaluated(rows).withColumn("g", most.original(F.col("f"))).orderBy("id").collect()] == [(-25.0, 25.0), (-81.0, 81.0)]
    assert [r.f for r in both.evaluated(rows).orderBy("id").collect()] == [[3.0, 4.0], [0.0, 9.0]]
    assert [r[0] for r in rows.select(least.repaired(F.col("x"))).collect()] == [[3.0, 4.0], [0.0, 5.0]]
    with pytest.raises(Exception, match="3 numbers, not 2"):
        problem.Problem(objectives.sphere, 3, 0.0, 1.0).evaluated(rows).collect()
    with pytest.raises(Exception, match="3 objectives"):
        problem.Problem(lambda x: x, 2, 0.0, 1.0, ("a", "b", "c")).evaluated(rows).collect()
    for wrong in ({"dimension": 0}, {"low": 2.0}, {"names": ()}):
        with pytest.raises(ValueError):
            problem.Problem(**{"objective": objectives.sphere, "dimension": 2, "low": 0.0, "high": 1.0} | wrong)
    assert rows.select(problem.log_scaled(F.lit(-2.0)).alias("v")).first().v == pytest.approx(0.01)


def test_dipeptide_features(spark):
    rows = spark.createDataFrame([(1, "AACA"), (2, "y"), (3, "123"), (4, None)], "id long, s string")
    found = {r.id: r.features for r in sequences.featurized(rows, "s", "dpc").collect()}
    assert sorted(found) == [1, 2] and len(found[1]) == 400 and sum(found[2]) == 0
    kinds = [a + b for a in sequences.RESIDUES for b in sequences.RESIDUES]
    assert {k: v for k, v in zip(kinds, found[1]) if v} == {"AA": pytest.approx(1 / 3), "AC": pytest.approx(1 / 3), "CA": pytest.approx(1 / 3)}

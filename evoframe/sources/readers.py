"""Readers of the file formats that the data sets come in: CSV, TSV, edge lists and series matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoframe.sources.store import kept, resolve

#: Columns that are no labels, by data set.
EXTRAS = {"sider": (), "tox21": ("mol_id",), "bbbp": ("num", "name"), "clintox": (), "hiv": ("activity",)}

#: The files of the edge lists, by kind of target.
SUBSETS = {"enzyme": "bind_orfhsa_drug_e.txt", "ion_channel": "bind_orfhsa_drug_ic.txt", "gpcr": "bind_orfhsa_drug_gpcr.txt", "nuclear_receptor": "bind_orfhsa_drug_nr.txt"}

#: Names in the files and in the engine.
DTI = {"ID1": "drug_id", "X1": "smiles", "ID2": "target_id", "X2": "sequence", "Y": "affinity"}
DDI = {"ID1": "drug1_id", "ID2": "drug2_id", "Y": "interaction_type", "Map": "description", "X1": "smiles1", "X2": "smiles2"}


def _complete(rows: DataFrame, wanted, kind: str) -> DataFrame:
    """``rows``, an error that names the columns that are not there."""
    missing = sorted(set(wanted) - set(rows.columns))
    if missing:
        raise ValueError(f"this is no {kind} table: there is no column {', '.join(missing)}; there are {', '.join(rows.columns)}")
    return rows


def molecules(spark: SparkSession, path: str, kind: str, folder: str | None = None) -> tuple[DataFrame, list[str]]:
    """A molecule table, ``sider``, ``tox21``, ``bbbp``, ``clintox`` or ``hiv``, and the names of its label columns; labels are numbers or null.

    ``path`` may be empty where a table was kept in ``folder`` before. Types are not inferred, so the file is read once.
    """
    if kind not in EXTRAS:
        raise ValueError(f"the kind is one of {', '.join(EXTRAS)}")
    if folder is None:
        rows = spark.read.csv(path, header=True)
    else:
        rows = kept(spark, f"{folder.rstrip('/')}/{kind}", lambda: spark.read.csv(resolve(spark, path or None, folder), header=True))
    labels = [c for c in _complete(rows, ("smiles",), kind).columns if c not in ("smiles", *EXTRAS[kind])]
    return rows.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in labels}) if labels else rows, labels


def drug_targets(spark: SparkSession, path: str, log_transform: bool = True) -> DataFrame:
    """Drug-target pairs; with ``log_transform`` the affinity, given in nanomoles, as pKd. Scores that are no constants are read without."""
    rows = _complete(spark.read.csv(path, header=True, sep="\t"), DTI, "drug-target").select(*DTI).withColumnsRenamed(DTI)
    rows = rows.withColumn("affinity", F.col("affinity").cast("double"))
    return rows.withColumn("affinity", -F.log10(F.col("affinity") * F.lit(1e-9))) if log_transform else rows


def drug_drugs(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Drug-drug pairs with the kind of their interaction, a whole number."""
    rows = _complete(spark.read.csv(path, header=True, sep=sep), DDI, "drug-drug").select(*DDI).withColumnsRenamed(DDI)
    return rows.withColumn("interaction_type", F.col("interaction_type").cast("long"))


def edges(spark: SparkSession, path: str, subset: str | None = None) -> DataFrame:
    """A drug-target edge list without a header; with ``subset`` the file of that name in the folder ``path``."""
    if subset is not None and subset not in SUBSETS:
        raise ValueError(f"the subset is one of {', '.join(SUBSETS)}")
    file = path if subset is None else f"{path.rstrip('/')}/{SUBSETS[subset]}"
    return spark.read.csv(file, sep="\t", schema="target_id string, drug_id string")


def arrays(rows: DataFrame, kind: str) -> DataFrame:
    """What a model is fitted on: the columns of ``dti`` or ``ddi`` pairs that hold inputs and the label."""
    wanted = {"dti": ("smiles", "sequence", "affinity"), "ddi": ("smiles1", "smiles2", "interaction_type")}
    if kind not in wanted:
        raise ValueError("the kind is dti or ddi")
    return _complete(rows, wanted[kind], kind).select(*wanted[kind])


def series_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``sample_id, probe_id, value`` and ``sample_id, meta`` of a series matrix; see ``sources.series``."""
    from evoframe.sources.series import series_of

    found = series_of(spark, path)
    return found.cells, found.notes

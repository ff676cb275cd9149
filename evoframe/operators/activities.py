"""Measured activities of molecules against one target: fetched page by page, cleaned in counted steps, one row for each molecule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoframe.operators import clean
from evoframe.sources.paged import PagedSource, get_json
from evoframe.sources.store import kept

#: The columns of the service's records.
RECORD = (
    "molecule_chembl_id string, canonical_smiles string, standard_type string, standard_relation string, standard_value double, "
    "standard_units string, pchembl_value double, assay_chembl_id string, target_organism string"
)


def fetched(
    spark: SparkSession, url: str, target: str, kind: str = "IC50", folder: str | None = None, refresh: bool = False, most: int | None = None, **options
) -> DataFrame:
    """All records of a target, uncleaned; kept in ``folder``, so that other ways to clean them fetch nothing again.

    Without a folder they are fetched at every use. No records are an error.
    """
    from urllib.parse import urlencode

    spark.dataSource.register(PagedSource)
    options |= {} if most is None else {"most": most}
    query = urlencode({"target_chembl_id": target, "standard_type": kind})

    def make() -> DataFrame:
        rows = spark.read.format("paged_json").schema(RECORD).options(url=url, query=query, records="activities", **options).load()
        if rows.isEmpty():
            raise ValueError(f"there are no {kind} records of {target}; look at the target and the kind")
        return rows

    return kept(spark, f"{folder.rstrip('/')}/{target}_{kind}", make, refresh=refresh) if folder else make()


def status(url: str, timeout: float = 60) -> dict:
    """What the service says of itself; its release belongs to every count that is reported."""
    return get_json(url, timeout)


def target_table(
    records: DataFrame, relation: str | None = "=", units: str | None = "nM", organism: str | None = None, how: str | None = "median", row_id: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``molecule_chembl_id, smiles, pchembl, n_measurements`` and the funnel ``step_no, step, n``.

    Records need a structure, the relation, the units, the organism and a value; None skips a
    step. ``row_id`` tells which of a molecule's structures is the first; without it the
    smallest is taken. The funnel is counted in one pass, and nothing left is an error.
    """
    steps = [("records fetched", F.lit(True)), ("with SMILES", F.col("canonical_smiles").isNotNull())]
    for name, column, wanted in (("relation", "standard_relation", relation), ("units", "standard_units", units), ("organism", "target_organism", organism)):
        if wanted is not None:
            steps.append((f"{name} {wanted!r}", F.col(column) == wanted))
    steps.append(("with pChEMBL", F.col("pchembl_value").isNotNull()))
    left = records
    for _, condition in steps:
        left = left.where(condition)
    named = left.withColumns({"smiles": F.col("canonical_smiles"), "pchembl": F.col("pchembl_value").cast("double")})
    table = clean.collapse(named, "molecule_chembl_id", "pchembl", "smiles", row_id or "smiles", how)
    counts = clean.funnel(records, steps)
    if not counts.where(F.col("step") == "with pChEMBL").first()["n"]:
        raise ValueError("no records survived filtering; relax the relation, the units or the organism")
    last = left.agg(F.countDistinct("molecule_chembl_id").alias("n")).select(F.lit(len(steps)).alias("step_no"), F.lit("unique molecules").alias("step"), "n")
    return table.select("molecule_chembl_id", "smiles", "pchembl", "n_measurements"), counts.unionByName(last)


def report(funnel: DataFrame) -> str:
    """The funnel, a few rows, as text with one line for each step."""
    rows = sorted(funnel.collect(), key=lambda r: r.step_no)
    width = max((len(r.step) for r in rows), default=0)
    return "\n".join(f"{r.step:<{width}} : {r.n}" for r in rows)

"""Series matrices: a text of two sections, notes on the samples and a table of probes by samples."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evoframe.operators import clean
from evoframe.sources.store import kept, resolve

#: Marks in the files, an accession's form and where its file lies.
BEGIN, END, NOTE = "!series_matrix_table_begin", "!series_matrix_table_end", "!Sample_"
ACCESSION = r"GSE\d{1,}"
ADDRESS = "https://ftp.ncbi.nlm.nih.gov/geo/series/{stub}/{accession}/matrix/{accession}_series_matrix.txt.gz"
PLAIN = {"title": "title", "source_name_ch1": "source_name"}


def matrix_url(accession: str) -> str:
    """Where the file of a series lies."""
    accession = accession.strip().upper()
    if not re.fullmatch(ACCESSION, accession):
        raise ValueError(f"{accession!r} is no accession of a series")
    return ADDRESS.format(stub=accession[:-3] + "nnn", accession=accession)


def _bare(cell: Column) -> Column:
    """Without white space and one pair of quotes around it."""
    return F.regexp_replace(F.trim(cell), '^"(.*)"$', "$1")


@dataclass
class Series:
    """``cells``: ``sample_id, probe_id, value``; ``notes``: ``sample_id, meta``, a map for each sample of the table."""

    cells: DataFrame
    notes: DataFrame

    def columns(self) -> list[str]:
        """Names that any sample has a note under; few, whatever the number of samples."""
        return sorted(r[0] for r in self.notes.select(F.explode(F.map_keys("meta"))).distinct().collect())

    def labels(self, column: str) -> DataFrame:
        """``sample_id, y``: a note of each sample, null where it has none. An unknown name is an error that lists those there are."""
        known = self.columns()
        if column not in known:
            raise KeyError(f"no note {column!r}; there are: {', '.join(known)}")
        return self.notes.select("sample_id", F.element_at("meta", F.lit(column)).alias("y"))

    def cleaned(self, dropna_threshold: float | None = None, impute: str | None = None) -> "Series":
        """Without probes of which more than the threshold is missing, and with the rest filled by their probe's mean or median."""
        if dropna_threshold is not None and not 0 <= dropna_threshold <= 1:
            raise ValueError("dropna_threshold is in [0, 1]")
        if impute not in (None, "mean", "median"):
            raise ValueError("impute is mean or median")
        cells = self.cells if dropna_threshold is None else clean.drop_missing(self.cells, "probe_id", "value", dropna_threshold)
        return Series(cells if impute is None else clean.impute(cells, "probe_id", "value", impute).select("sample_id", "probe_id", "value"), self.notes)


def parsed(lines: DataFrame) -> Series:
    """A series from its lines ``line, value``, numbered in their order.

    The marks' places, one row, split the lines; each section is then filtered by them. Cells that are no numbers
    are missing. Notes come from the lines in front of the table: titles, source names, and
    characteristics, either ``name: value``, where a later line takes the place of an earlier
    one, or free text, of which the first is kept under ``characteristics``.
    """
    lines = lines.select("line", F.rtrim("value").alias("value"))
    marks = lines.where(F.col("value").startswith("!series_matrix_table_")).select("line", "value")
    found = marks.agg(F.min(F.when(F.col("value").startswith(BEGIN), F.col("line"))).alias("begin"), F.min(F.when(F.col("value").startswith(END), F.col("line"))).alias("end")).first()
    if found.begin is None:
        raise ValueError("this is no series matrix: there is no table in it")
    inside = F.col("line") > found.begin
    if found.end is not None:
        inside &= F.col("line") < found.end
    table = lines.where(inside & (F.trim("value") != "")).select("line", F.split("value", "\t").alias("cells"))
    first = table.agg(F.min("line")).first()[0]
    at = F.lit(-1 if first is None else first)
    head = table.where(F.col("line") == at).select(F.posexplode("cells").alias("pos", "cell")).where("pos > 0").select("pos", _bare(F.col("cell")).alias("sample_id"))
    body = table.where(F.col("line") != at).select(_bare(F.col("cells")[0]).alias("probe_id"), F.posexplode("cells").alias("pos", "cell"))
    cells = body.where("pos > 0").join(head, "pos").select("sample_id", "probe_id", _bare(F.col("cell")).try_cast("double").alias("value"))

    front = lines.where((F.col("line") < found.begin) & F.col("value").startswith(NOTE))
    parts = front.select("line", F.split("value", "\t").alias("parts")).select("line", F.expr(f"substring(parts[0], {len(NOTE) + 1})").alias("key"), F.posexplode("parts").alias("pos", "cell"))
    parts = parts.where("pos > 0").select("line", "key", "pos", _bare(F.col("cell")).alias("cell"))
    ids = parts.where("key = 'geo_accession'")
    ids = ids.withColumn("_n", F.row_number().over(Window.partitionBy("pos").orderBy("line"))).where("_n = 1").select("pos", F.col("cell").alias("sample_id"))
    ids = ids if not ids.isEmpty() else head  # without a line of accessions, the table's own
    plain = F.create_map(*[F.lit(x) for pair in PLAIN.items() for x in pair])
    split = F.split("cell", ":", 2)
    named = F.size(split) == 2
    is_plain, is_trait = F.col("key").isin(*PLAIN), F.col("key").startswith("characteristics") & (F.col("cell") != "")
    # free text never takes the place of a name, so it counts as earlier, and the first of it as the latest
    rank = F.struct(F.when(is_trait, 1).otherwise(0).alias("kind"), F.when(is_trait & ~named, 0).otherwise(1).alias("named"),
                    F.when(is_trait & ~named, -F.col("line")).otherwise(F.col("line")).alias("line"))
    name = F.when(is_plain, F.element_at(plain, F.col("key"))).when(named, F.trim(split[0])).otherwise(F.lit("characteristics"))
    value = F.when(is_plain | ~named, F.col("cell")).otherwise(F.trim(split[1]))
    noted = parts.where(is_plain | is_trait).select("pos", name.alias("name"), F.when(value != "", value).alias("value"), rank.alias("rank")).join(ids, "pos")
    last = noted.groupBy("sample_id", "name").agg(F.max_by("value", "rank").alias("value"))
    meta = last.groupBy("sample_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("meta"))
    empty = F.create_map().cast("map<string,string>")
    return Series(cells, head.join(meta, "sample_id", "left").select("sample_id", F.coalesce("meta", empty).alias("meta")))


def series_of(spark: SparkSession, source: str, folder: str | None = None, fetch=None) -> Series:
    """A series from a file, or from its accession: fetched once and kept in ``folder``.

    ``fetch(address)`` gives the lines of a file as a DataFrame ``line, value``; without it Spark reads the address.
    """
    if re.fullmatch(ACCESSION, source.strip().upper()):
        if folder is None:
            raise ValueError("an accession needs a folder to keep its file in")
        address = matrix_url(source)
        make = (lambda: fetch(address)) if fetch else (lambda: numbered(spark, address))
        return parsed(kept(spark, f"{folder.rstrip('/')}/{source.strip().upper()}", make))
    return parsed(numbered(spark, resolve(spark, source, "")))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """``line, value``: the lines of one text file and numbers in their order."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value")

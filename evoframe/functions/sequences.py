"""Features of protein sequences and molecule strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"

#: Fixed value: atoms and bonds of molecule strings.
ATOMS = r"(\[[^\]]+]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|/|:|~|@|\?|>|\*|\$|%[0-9]{2}|[0-9])"

#: Three groups of residues by property.
GROUPS = {
    "hydrophobicity": ("RKEDQN", "GASTPHY", "CLVIMFW"),
    "vdw_volume": ("GASTPDC", "NVEQIL", "MHKFRYW"),
    "polarity": ("LIFWCMVY", "PATGS", "HQRKNED"),
    "polarizability": ("GASDT", "CPNVEQIL", "KMHFRYW"),
    "charge": ("KR", "ANCQGHILMFPSTWYV", "DE"),
    "secondary_structure": ("EALMQKRH", "VIYCWFT", "GNPSD"),
    "solvent_accessibility": ("ALFCGIVW", "RKQEND", "MPSTHY"),
}
FRACTIONS = (0, 25, 50, 75, 100)
START, END, UNKNOWN = "!", "E", "?"


def clean_protein(sequence: Column) -> Column:
    """Upper case, without anything but the twenty residues."""
    return F.regexp_replace(F.upper(sequence), f"[^{RESIDUES}]", "")


def aac(sequence: Column) -> Column:
    """The share of each residue, in the order of ``RESIDUES``; null for an empty sequence."""
    n = F.length(sequence)
    parts = [(n - F.length(F.replace(sequence, F.lit(a)))) / F.when(n > 0, n) for a in RESIDUES]
    return F.when(n > 0, F.array(*parts))


def dipeptides(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """``key, dipeptide, share`` of the neighbouring pairs that occur."""
    n = F.length(sequence)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(F.col(sequence), i, F.lit(2)))
    cut = rows.where(n > 1).select(key, (n - 1).alias("_n"), F.explode(pairs).alias("dipeptide"))
    counted = cut.groupBy(key, "dipeptide").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    return counted.select(key, "dipeptide", (F.col("_c") / F.col("_n")).alias("share"))


def composition(sequence: Column, groups: tuple[str, str, str]) -> Column:
    """The share of residues in each of three groups."""
    n = F.length(sequence)
    inside = [n - F.length(F.regexp_replace(sequence, f"[{g}]", "")) for g in groups]
    return F.when(n > 0, F.array(*[c / F.when(n > 0, n) for c in inside]))


def tokenize(smiles: Column, how: str = "char") -> Column:
    """The characters, or the atoms and bonds; an empty string has none."""
    if how == "char":
        return F.when(F.length(smiles) > 0, F.split(smiles, "")).otherwise(F.array().cast("array<string>"))
    if how == "atom":
        return F.regexp_extract_all(smiles, F.lit(ATOMS), F.lit(1))
    raise ValueError("tokens are by char or atom")


def vocabulary(rows: DataFrame, tokens: str) -> DataFrame:
    """``token, index``: end, start and unknown first, then all others in code point order."""
    own = rows.select(F.explode(tokens).alias("token")).distinct().where(~F.col("token").isin(START, END, UNKNOWN))
    fixed = rows.sparkSession.createDataFrame([(END, 0), (START, 1), (UNKNOWN, 2)], "token string, index long")
    # distinct characters or atoms: a bounded alphabet, so one window is small
    return fixed.unionByName(own.withColumn("index", (F.row_number().over(Window.orderBy("token")) + 2).cast("long")))


def encode(tokens: Column, index: Column, length: int) -> Column:
    """Start, the tokens' indexes (unknown for others) and ends, cut or filled to ``length``."""
    known = F.transform(F.slice(tokens, 1, length - 1), lambda t: F.coalesce(F.try_element_at(index, t), F.lit(2)))
    known = F.concat(F.array(F.lit(1)), known.cast("array<int>"))
    return F.concat(known, F.array_repeat(F.lit(0), length - F.size(known)))


def one_hot(codes: Column, size: int) -> Column:
    """For each code an array of ``size`` zeros with a one at its place."""
    places = F.sequence(F.lit(0), F.lit(size - 1))
    return F.transform(codes, lambda code: F.transform(places, lambda k: (k == code).cast("tinyint")))


def from_one_hot(marks: Column) -> Column:
    """The codes again: the place of the first largest entry."""
    return F.transform(marks, lambda m: (F.array_position(m, F.array_max(m)) - 1).cast("int"))


def decode(codes: Column, token: Column) -> Column:
    """The string of a sequence of codes, without start and end; ``token`` maps a code to its token."""
    return F.array_join(F.transform(F.filter(codes, lambda c: ~c.isin(0, 1)), lambda c: F.element_at(token, c.cast("long"))), "")


def ctd_names() -> list[str]:
    """The 147 names, in the order of ``ctd``."""
    out = []
    for name in GROUPS:
        out += [f"{name}_C{g}" for g in (1, 2, 3)] + [f"{name}_T{a}{b}" for a, b in ((1, 2), (1, 3), (2, 3))]
        out += [f"{name}_D{g}_{p}" for g in (1, 2, 3) for p in FRACTIONS]
    return out


def ctd(column: str) -> Column:
    """Composition, transition and distribution of three groups by seven properties; null for an empty sequence.

    The distribution tells where, in percent of the length, the first, each further
    quarter and the last residue of a group stand. Written as one SQL expression, whose
    lambdas work out each property's string and each group's places once.
    """
    n, parts = f"length(`{column}`)", []
    ranks = [f"get(p, int(greatest(ceil({f / 100}D * size(p)), 1)) - 1)" for f in FRACTIONS]
    places = ", ".join(f"CASE WHEN size(p) > 0 THEN {rank} / {n} * 100.0D ELSE 0.0D END" for rank in ranks)
    for groups in GROUPS.values():
        code = f"translate(`{column}`, '{''.join(groups)}', '{''.join(str(k) * len(g) for k, g in enumerate(groups, 1))}')"
        values = [f"({n} - length(replace(code, '{g}'))) / {n}" for g in "123"]
        values += [f"regexp_count(code, '{a}(?={b})|{b}(?={a})') / greatest({n} - 1, 1)" for a, b in ("12", "13", "23")]
        spread = [f"filter(transform(split(code, ''), (c, i) -> CASE WHEN c = '{g}' THEN i + 1 END), i -> i IS NOT NULL)" for g in "123"]
        spread = [f"element_at(transform(array({at}), p -> array({places})), 1)" for at in spread]
        parts.append(f"element_at(transform(array({code}), code -> concat(array({', '.join(values)}), {', '.join(spread)})), 1)")
    return F.expr(f"CASE WHEN {n} > 0 THEN concat({', '.join(parts)}) END")


def dpc(s: Column) -> Column:
    """The share of each of the 400 pairs of neighbours, in the order of residues; all 0 for a single residue, null for none."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2)))
    kinds = F.flatten(F.transform(F.split(F.lit(RESIDUES), ""), lambda a: F.transform(F.split(F.lit(RESIDUES), ""), lambda b: F.concat(a, b))))
    shares = F.get(F.transform(F.array(pairs), lambda p: F.transform(kinds, lambda k: F.size(F.filter(p, lambda q: q == k)) / F.size(p))), F.lit(0))
    return F.when(F.length(s) > 1, shares).when(F.length(s) == 1, F.array_repeat(F.lit(0.0), len(RESIDUES) ** 2))


def featurized(rows: DataFrame, sequence: str, method: str = "aac", on_invalid: str = "drop") -> DataFrame:
    """``rows`` with ``features`` by ``aac``, ``dpc`` or ``ctd``; those without any residue go, or raise an error."""
    if method not in ("aac", "dpc", "ctd") or on_invalid not in ("drop", "raise"):
        raise ValueError("aac, dpc or ctd, drop or raise")
    cleaned = rows.withColumn("_cleaned", clean_protein(F.coalesce(sequence, F.lit(""))))
    made = cleaned.withColumn("features", ctd("_cleaned") if method == "ctd" else {"aac": aac, "dpc": dpc}[method](F.col("_cleaned"))).drop("_cleaned")
    if on_invalid == "drop":
        return made.where(F.col("features").isNotNull())
    sound = F.assert_true(F.col("features").isNotNull(), F.lit("a sequence without residues")).isNull()
    return made.withColumn("features", F.when(sound, F.col("features")))

"""Paired data: leakage-free splits, sampled negatives, pair features and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoframe.functions.hashing import first_by_hash, number_of, permuted, ranked_within, share, summed_before
from evoframe.functions.lineage import checkpointed

MODES = ("random", "drug", "target", "both")


def held_out(pairs: DataFrame, column: str, test_size: float, seed: int) -> DataFrame:
    """The values of one column that are held out, as a sample of exact size."""
    entities = pairs.select(column).distinct()
    return first_by_hash(entities, share(entities.count(), test_size), seed, column)


def cold_split(pairs: DataFrame, drug: str, target: str, test_size: float = 0.2, mode: str = "drug", seed: int = 0, row_id: tuple = ()) -> DataFrame:
    """``pairs`` with ``split``: train, test, or dropped where only one side of a pair is held out in mode ``both``.

    Mode ``random`` needs ``row_id``, columns that tell rows apart.
    """
    if mode not in MODES or not 0 < test_size < 1:
        raise ValueError(f"mode is one of {MODES}, test_size between 0 and 1")
    if mode == "random":
        total = pairs.count()
        test = first_by_hash(pairs.select(*row_id), min(share(total, test_size), total - 1), seed, *row_id)
        marked = pairs.join(test.withColumn("_test", F.lit(True)), list(row_id), "left")
        return marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")
    sides = {"drug": (drug,), "target": (target,), "both": (drug, target)}[mode]
    marked, flags = pairs, []
    for k, column in enumerate(sides):
        out = held_out(pairs, column, test_size, seed + k).withColumn(f"_out{k}", F.lit(True))
        marked = marked.join(out, column, "left")
        flags.append(F.coalesce(f"_out{k}", F.lit(False)))
    hits = sum((f.cast("int") for f in flags), F.lit(0))
    split = F.when(hits == len(flags), "test").when(hits == 0, "train").otherwise("dropped")
    return marked.withColumn("split", split).drop(*[f"_out{k}" for k in range(len(sides))])


def every_pair(drugs: DataFrame, targets: DataFrame, target: str) -> DataFrame:
    """Each row of ``drugs`` with each row of ``targets``, by one equality join.

    Targets are dealt to blocks by hash and the drugs are copied to every block, as many
    as there are shuffle partitions, so both sides may grow. The number of partitions is
    given, since by their bytes the few rows before the join would be read by one task.
    """
    blocks = max(1, int(drugs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    copies = drugs.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = targets.withColumn("_block", F.pmod(F.xxhash64(target), F.lit(blocks)).cast("int"))
    return copies.repartition(blocks, "_block").join(dealt.repartition(blocks, "_block"), "_block").drop("_block")


def cells(pairs: DataFrame, drug: str, target: str, together: int = 4096) -> DataFrame:
    """``drug, target, cell``: every drug with every target, 1 where the pair is known and else 0.

    Drugs are dealt to parts of about ``together`` and each has a bit in one of its part's
    words of 64. A row of a target and a part carries the words that are not all 0; its cells
    are made from it and the part's list of drugs, and are never shuffled. A cell is a bit of
    its word, so nothing is searched for it. Tasks are as many as the cells ask for, and each
    has several groups of rows, so that they are about equal.
    """
    drugs, targets = checkpointed(pairs.select(drug).distinct()), checkpointed(pairs.select(target).distinct())
    n_drugs = drugs.count()
    parts = max(1, -(-n_drugs // together))
    tasks = max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), n_drugs * targets.count() >> 26)
    blocks = -(-4 * tasks // parts)
    lists = drugs.groupBy(F.pmod(F.xxhash64(drug), F.lit(parts)).cast("int").alias("_part")).agg(F.collect_list(F.struct(drug)).alias("_drugs"))  # a struct, so that a null one stays
    starts = F.sequence(F.lit(1), F.size("_drugs"), F.lit(64))
    lists = checkpointed(lists.select("_part", F.transform(starts, lambda at: F.slice(F.col("_drugs")[drug], at, F.lit(64))).alias("_words")))  # their order is fixed from here on
    placed = lists.select("_part", F.posexplode("_words").alias("_word", "_w")).select("_part", "_word", F.posexplode("_w").alias("_bit", "_d"))
    whole = pairs.select(drug, target).where(F.col(target).isNotNull())  # a null equals nothing
    known = whole.join(placed, F.col(drug) == F.col("_d")).groupBy(target, "_part", "_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    rows = known.unionByName(targets.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), allowMissingColumns=True)
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(target), F.lit(blocks)).cast("int"))
    lists = lists.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ("_part", "_block")  # the number of partitions is given, as in ``every_pair``
    words = F.collect_list(F.when(F.col("_word").isNotNull(), F.struct("_word", "_bits")))
    rows = rows.repartition(tasks, *keys).groupBy(*keys, target).agg(F.map_from_entries(words).alias("_known"))
    met = rows.join(lists.repartition(tasks, *keys), list(keys)).select(target, "_known", F.posexplode("_words").alias("_word", "_w"))
    met = met.select(target, F.coalesce(F.try_element_at("_known", F.col("_word")), F.lit(0).cast("long")).alias("_bits"), "_w")  # looked up once a word, before its cells
    return met.select(target, "_bits", F.posexplode("_w").alias("_bit", drug)).select(drug, target, F.expr("shiftright(_bits, _bit) & 1L").alias("cell"))


def unknown_pairs(known: DataFrame, drug: str, target: str, wanted: int, seed: int = 0) -> DataFrame:
    """``drug, target``: ``wanted`` distinct pairs (all, if there are fewer) of drugs and targets that ``known``, distinct pairs, does not hold.

    Drugs and targets are numbered in a hashed order, and so, drug by drug, are the pairs
    that are not known. The draws are the first numbers of a permutation, so their size is
    exact. Which pair has a number follows from the known ones: between two neighbours of a
    drug the unknown targets run on, so each known pair ends one run of numbers. Draws meet
    runs by an equality join over equal stretches of numbers; no pair is made that is not drawn.
    """
    spark = known.sparkSession

    def numbered(column: str, salt: int, name: str) -> DataFrame:
        rows = known.select(column).distinct().withColumns({"_h": number_of(seed + salt, column), "_all": F.lit(0)})
        return checkpointed(ranked_within(rows, "_all", "_h", name, column).select(column, name))

    targets, drugs = numbered(target, 1, "_t"), numbered(drug, 0, "_d")
    n_targets = targets.count()
    placed = known.join(targets, target).select(drug, "_t")
    placed = checkpointed(ranked_within(placed, drug, "_t", "_i").select(drug, "_i", (F.col("_t") - F.col("_i")).alias("_from")))  # unknown ones before it
    sizes = placed.groupBy(drug).agg((n_targets - F.count(F.lit(1))).alias("_unknown"))
    sizes = checkpointed(summed_before(drugs.join(sizes, drug), "_d", "_unknown", "_before"))
    total = sizes.agg(F.sum("_unknown")).first()[0] or 0
    wanted = min(wanted, total)
    if wanted <= 0:
        return known.select(drug, target).limit(0)

    # runs of unknown targets: from each known one, or the first target, to the next known one, or the last target
    starts = placed.unionByName(sizes.select(drug, F.lit(-1).cast("long").alias("_i"), F.lit(0).cast("long").alias("_from")))
    ends = placed.select(drug, (F.col("_i") - 1).alias("_i"), F.col("_from").alias("_to"))
    runs = starts.join(ends, [drug, "_i"], "left").join(sizes.select(drug, "_unknown", "_before"), drug)
    runs = runs.withColumn("_to", F.coalesce("_to", "_unknown")).where("_from < _to")
    runs = runs.select(drug, (F.col("_before") + F.col("_from")).alias("_low"), (F.col("_before") + F.col("_to")).alias("_high"), (F.col("_i") + 1 - F.col("_before")).alias("_shift"))
    stretch = max(1, total // max(1, placed.count()))
    cut = runs.withColumn("_stretch", F.explode(F.sequence(F.floor(F.col("_low") / stretch), F.floor((F.col("_high") - 1) / stretch))))
    draws = spark.range(wanted).select(permuted(F.col("id"), total, seed).alias("_r"))
    draws = draws.withColumn("_stretch", F.floor(F.col("_r") / stretch))
    met = draws.join(cut, "_stretch").where("_low <= _r AND _r < _high").select(drug, (F.col("_r") + F.col("_shift")).alias("_t"))
    return met.join(targets, "_t").select(drug, target)


def with_negatives(positives: DataFrame, drug: str, target: str, ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """``drug, target, label``: the distinct positives and a sample of the pairs that are none, of exact size; its cost follows both."""
    known = checkpointed(positives.select(drug, target).where(F.col(drug).isNotNull() & F.col(target).isNotNull()).distinct())
    sampled = unknown_pairs(known, drug, target, round(ratio * known.count()), seed)
    return known.withColumn("label", F.lit(1)).unionByName(sampled.withColumn("label", F.lit(0)))


def one_against_rest(pairs: DataFrame, kind: str, wanted, row_id: tuple, ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """All rows of one kind with label 1 and a sample of the other kinds with label 0."""
    positives, others = pairs.where(F.col(kind) == F.lit(wanted)), pairs.where(F.col(kind) != F.lit(wanted))
    n = positives.count()
    if not n or ratio < 0:
        raise ValueError("no row of this kind, or a negative ratio")
    sampled = first_by_hash(others, min(round(ratio * n), others.count()), seed, *row_id)
    return positives.withColumn("label", F.lit(1)).unionByName(sampled.withColumn("label", F.lit(0)))


def kinds(pairs: DataFrame, kind: str, description: str, row_id: str) -> DataFrame:
    """``kind, n, description`` of its first row, the most frequent first, ties by kind."""
    found = pairs.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.min_by(description, row_id).alias("description"))
    return found.orderBy(F.desc("n"), kind)


def n_entities(pairs: DataFrame, *columns: str) -> DataFrame:
    """``n``: distinct non-null values over several columns."""
    return pairs.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("v")).agg(F.countDistinct("v").alias("n"))


COMBINE = {
    "sum": lambda a, b: a + b,
    "product": lambda a, b: a * b,
    "absdiff": lambda a, b: F.abs(a - b),
    "mean": lambda a, b: (a + b) / 2,
    "max": lambda a, b: F.greatest(a, b),
}


def pair_features(left: Column, right: Column, method: str = "concat") -> Column:
    """One array for a pair of arrays: both, or a symmetric combination of each component."""
    if method == "concat":
        return F.concat(left, right)
    if method not in COMBINE:
        raise ValueError(f"method is concat or one of {tuple(COMBINE)}")
    same = F.assert_true(F.size(left) == F.size(right), F.lit("pairs need arrays of one length")).isNull()
    return F.when(same, F.zip_with(left, right, COMBINE[method]))

"""Exact nearest neighbours in blocks, and models judged by them: cross-validated selection of features.

Rows are packed into blocks of bounded size. Every block of queries meets every block of
references once, as one row of work; a task keeps the ``k`` nearest of each query over the
blocks that it is given, so the pairs of rows never exist as rows. A product of matrices tells which pairs
may count, and only those are summed up feature by feature. Candidates, masks over the features, come in blocks too
and share each meeting. Work is dealt out over all tasks, so no task and no driver holds more than a
few blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.functions import metrics
from evoframe.functions.hashing import ranked_within
from evoframe.operators.objectives import selected

QUERIES, REFERENCES, CANDIDATES = 2048, 8192, 32
#: Blocks of references that one task holds against a block of queries, one after the other.
TOGETHER = 32
_NONE = (1 << 63) - 1

_PACK = "block long, ids binary, folds binary, labels binary, data binary"
_FOUND = "cand_id long, id long, d double, other long, label long"


def _packed(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` rows by hash, numbered from 0, and how many there are."""
    blocks = max(1, -(-rows.count() // size))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        data = np.array(group.x.tolist(), np.float64)
        whole = [group[c].to_numpy(np.int64).tobytes() for c in ("id", "fold", "label")]
        return pd.DataFrame({"block": [group.block.iloc[0]], "ids": [whole[0]], "folds": [whole[1]], "labels": [whole[2]], "data": [data.tobytes()]})

    made = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("block").applyInPandas(pack, _PACK)
    return made, blocks


def _masks(candidates: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Blocks of candidates with their selected features."""
    blocks = max(1, -(-candidates.count() // size))
    dealt = candidates.withColumn("masks", F.pmod(F.xxhash64("cand_id"), F.lit(blocks)))
    return dealt.groupBy("masks").agg(F.array_sort(F.collect_list(F.struct("cand_id", "features"))).alias("candidates")), blocks


def _near_enough(mine: np.ndarray, theirs: np.ndarray, k: int, far: np.ndarray, other_fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns that hold every pair of other folds that may be among a query's k nearest, and few others.

    ``far`` is how far each query's k-th find is so far. A product of
    matrices gives squared distances up to rounding, which ``slack`` times the squared lengths
    bounds several times over; so no pair is lost, and who calls works out the sums of the rest.
    """
    slack = 8.0 * (mine.shape[1] + 4) * np.finfo(float).eps
    with np.errstate(over="ignore", invalid="ignore"):
        own, their = (mine * mine).sum(axis=1), (theirs * theirs).sum(axis=1)
    if not (np.isfinite(own).all() and np.isfinite(their).all()):
        return np.nonzero(other_fold)
    # a lower bound of each distance, less the query's own part
    least = np.hstack([-2.0 * mine, np.ones((len(mine), 1))]) @ np.hstack([theirs, (their * (1.0 - slack))[:, None]]).T
    limit = far - own * (1.0 - slack)
    new = np.flatnonzero(np.isinf(far))
    if len(new) and len(theirs) > k:
        nth = np.partition(np.where(other_fold[new], least[new], np.inf), k - 1, axis=1)[:, k - 1]
        limit[new] = nth + 2.0 * slack * (own[new] + their.max())
    rows, columns = np.nonzero(least <= limit[:, None])
    known = other_fold[rows, columns]
    return rows[known], columns[known]


def _meet(k: int):
    """For rows of work: the k nearest references of other folds, for each query and candidate.

    Rows of one block of queries follow one another; their finds are merged before they leave the task.
    """

    def closest(row, kept: dict) -> None:
        ids, folds, others, other_folds, labels = (np.frombuffer(x, np.int64) for x in (row.ids, row.folds, row.other_ids, row.other_folds, row.other_labels))
        data, other = (np.frombuffer(x, np.float64).reshape(len(n), -1) for x, n in ((row.data, ids), (row.other_data, others)))
        for candidate in row.candidates:
            if candidate["cand_id"] not in kept:
                kept[candidate["cand_id"]] = np.full((len(ids), k), np.inf), np.full((len(ids), k), _NONE), np.zeros((len(ids), k), np.int64)
            d, near, label = kept[candidate["cand_id"]]
            features = list(candidate["features"])
            for at in range(0, len(ids), 128):
                some = slice(at, at + 128)
                rows, columns = _near_enough(data[some][:, features], other[:, features], k, d[some, -1], folds[some, None] != other_folds[None, :])
                distance = np.zeros(len(rows))
                for f in features:  # in order, so a sum is the same everywhere
                    gap = data[at + rows, f] - other[columns, f]
                    distance += gap * gap
                rows, columns, distance = (x[distance < np.inf] for x in (rows, columns, distance))
                if not len(rows):
                    continue
                who = at + np.unique(rows)
                row = np.concatenate([np.repeat(who, k), at + rows])
                both_d, both_near = np.concatenate([d[who].ravel(), distance]), np.concatenate([near[who].ravel(), others[columns]])
                both_label = np.concatenate([label[who].ravel(), labels[columns]])
                order = np.lexsort((both_near, both_d, row))
                order = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < k]
                d[who], near[who], label[who] = (x[order].reshape(-1, k) for x in (both_d, both_near, both_label))

    def found(ids: np.ndarray, kept: dict) -> pd.DataFrame:
        parts = []
        for cand_id, (d, near, label) in kept.items():
            rows, columns = np.nonzero(d < np.inf)
            parts.append((np.full(len(rows), cand_id), ids[rows], d[rows, columns], near[rows, columns], label[rows, columns]))
        names = ("cand_id", "id", "d", "other", "label")
        return pd.DataFrame({n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(names)})

    def run(batches):
        key, ids, kept = None, None, {}
        for batch in batches:
            for row in batch.itertuples():
                if (row.block, row.masks, row.part) != key:
                    if kept:
                        yield found(ids, kept)
                    key, ids, kept = (row.block, row.masks, row.part), np.frombuffer(row.ids, np.int64), {}
                closest(row, kept)
        if kept:
            yield found(ids, kept)

    return run


def neighbours_of(rows: DataFrame, candidates: DataFrame, k: int = 5, queries: int = QUERIES, references: int = REFERENCES) -> DataFrame:
    """``cand_id, id, place, other, d, label``: for each candidate ``cand_id, features`` and row the ``k`` nearest rows of other folds.

    ``rows`` have ``id, fold, label, x``; ``d`` is the squared distance over the features
    selected, ties go to the smaller id. Features are numbered from 0.
    """
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("fold").cast("long").alias("fold"), F.col("label").cast("long").alias("label"), F.col("x").cast("array<double>").alias("x"))
    asked, _ = _packed(rows, queries)
    known, blocks = _packed(rows, references)
    masks, mask_blocks = _masks(candidates.select(F.col("cand_id").cast("long").alias("cand_id"), F.col("features").cast("array<int>").alias("features")), CANDIDATES)
    known = known.select(*[F.col(c).alias(f"other_{c}") for c in known.columns])
    work = asked.withColumn("other_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    work = work.withColumn("masks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(mask_blocks - 1).cast("long"))))
    work = work.join(known, "other_block").join(masks, "masks").withColumn("part", F.floor(F.col("other_block") / TOGETHER))
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    keys = ("block", "masks", "part")  # a block of references goes to many tasks, so none is one task's
    work = work.repartition(tasks, *keys).sortWithinPartitions(*keys)
    found = work.mapInPandas(_meet(k), _FOUND)
    order = Window.partitionBy("cand_id", "id").orderBy("d", "other")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def stratified(rows: DataFrame, folds: int = 5) -> DataFrame:
    """``rows`` ``id, label, ...`` with ``fold``: consecutive rows of each class, its shares as even as the classes in order allow.

    Classes are few, and only their sizes reach the driver; ranks within a class are worked
    out over ranges of ids.
    """
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(sizes.values()) < folds or folds < 2:
        raise ValueError("there are two folds at least, and no fewer rows than folds")
    at, ends = 0, []
    for label in sorted(sizes):
        # positions at .. at + n - 1 of all rows in the order of classes are dealt to the folds in turn
        counts = [len(range(at + (f - at) % folds, at + sizes[label], folds)) for f in range(folds)]
        ends += [F.lit(label), F.array(*[F.lit(int(e)) for e in np.cumsum(counts)])]
        at += sizes[label]
    ranked = ranked_within(rows, "label", "id", "_rank")
    end = F.element_at(F.create_map(*ends), F.col("label"))
    return ranked.withColumn("fold", F.size(F.filter(end, lambda e: e <= F.col("_rank")))).drop("_rank")


def voted(found: DataFrame) -> DataFrame:
    """``cand_id, id, predicted``: the commonest label among the neighbours, ties to the smallest."""
    votes = found.groupBy("cand_id", "id", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("cand_id", "id").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("predicted"))


def cross_validated(rows: DataFrame, candidates: DataFrame, folds: int = 5, k: int = 5, scoring: str = "accuracy", **blocks) -> DataFrame:
    """``cand_id, score``: the mean over the folds of the metric (accuracy, f1, balanced_accuracy) of the vote of ``k`` neighbours."""
    if scoring not in ("accuracy", "f1", "balanced_accuracy"):
        raise ValueError("scoring is accuracy, f1 or balanced_accuracy")
    dealt = rows if "fold" in rows.columns else stratified(rows, folds)
    predicted = voted(neighbours_of(dealt, candidates, k, **blocks))
    judged = predicted.join(dealt.select("id", "label", "fold"), "id")
    by_fold = judged.groupBy("cand_id", "fold").agg(getattr(metrics, scoring)("label", "predicted").alias("s"))
    return by_fold.groupBy("cand_id").agg(F.avg("s").alias("score"))


def feature_selection_fitness(
    rows: DataFrame, candidates: DataFrame, folds: int = 5, k: int = 5, alpha: float = 0.99, threshold: float = 0.5, scoring: str = "accuracy", **blocks
) -> DataFrame:
    """``cand_id, n_selected, score, fitness`` of a batch of candidates ``cand_id, x``, one number in [0, 1] for each feature.

    ``fitness = alpha * (1 - score) + (1 - alpha) * n_selected / n_features``, 1 where nothing is
    selected. ``rows`` are ``id, label, x``, with ``fold`` if they are dealt already; labels are whole numbers.
    """
    if not 0 <= alpha <= 1 or not 0 <= threshold < 1:
        raise ValueError("alpha is in [0, 1], the threshold in [0, 1): only values above it are selected")
    width = F.size("x")
    marked = candidates.select("cand_id", selected(F.col("x"), threshold).alias("features"), width.alias("width"))
    sizes = rows.select(width.alias("w")).agg(F.min("w").alias("least"), F.max("w").alias("most")).first()
    if sizes.least != sizes.most or marked.where(F.col("width") != F.lit(sizes.most)).count():
        raise ValueError("rows and candidates need one number for each feature")
    scores = cross_validated(rows, marked.where(F.size("features") > 0), folds, k, scoring, **blocks)
    n = F.size("features")
    fitness: Column = alpha * (1.0 - F.col("score")) + (1.0 - alpha) * n / F.col("width")
    joined = marked.join(scores, "cand_id", "left")
    return joined.select("cand_id", n.cast("long").alias("n_selected"), "score", F.when(n > 0, fitness).otherwise(F.lit(1.0)).alias("fitness"))


def subset_objectives(rows: DataFrame, candidates: DataFrame, folds: int = 5, k: int = 5, threshold: float = 0.5, scoring: str = "accuracy", **blocks) -> DataFrame:
    """``cand_id, f``: the error of the vote and the share of the features selected, two objectives; ``[1, 0]`` where nothing is selected."""
    found = feature_selection_fitness(rows, candidates, folds, k, 1.0, threshold, scoring, **blocks)
    width = candidates.select("cand_id", F.size("x").alias("width"))
    error = F.when(F.col("n_selected") > 0, 1.0 - F.col("score")).otherwise(F.lit(1.0))
    return found.join(width, "cand_id").select("cand_id", F.array(error, F.col("n_selected") / F.col("width")).alias("f"))

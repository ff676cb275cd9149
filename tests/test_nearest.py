"""Nearest neighbours in blocks and the selection of features against brute force."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from evoframe.operators import nearest


def brute_folds(labels: list[int], folds: int) -> list[int]:
    """Rows of the sorted labels are dealt in turn; each class then takes its shares in the order of rows."""
    order = sorted(labels)
    shares = {c: [sum(1 for i in range(f, len(order), folds) if order[i] == c) for f in range(folds)] for c in set(labels)}
    seen, out = Counter(), []
    for c in labels:
        ends = np.cumsum(shares[c])
        out.append(int(np.searchsorted(ends, seen[c], "right")))
        seen[c] += 1
    return out


@pytest.fixture(scope="module")
def samples(spark):
    draw = np.random.default_rng(9)
    labels = draw.choice(3, 157, p=[0.6, 0.3, 0.1]).tolist()
    data = draw.integers(0, 4, (157, 6)).astype(float)  # many equal distances
    rows = [(i * 3, c, x.tolist()) for i, (c, x) in enumerate(zip(labels, data))]
    return spark.createDataFrame(rows, "id long, label long, x array<double>").repartition(3), labels, data


@pytest.mark.parametrize("queries, references", [(4096, 8192), (20, 30)])
def test_fitness_against_brute_force(spark, samples, queries, references):
    rows, labels, data = samples
    folds = brute_folds(labels, 4)
    assert [r.fold for r in nearest.stratified(rows, 4).orderBy("id").collect()] == folds
    masks = [[1, 1, 1, 1, 1, 1], [0.6, 0, 0, 0.51, 0, 0.5], [0] * 6, [0, 0, 1, 0, 0, 0]]
    batch = spark.createDataFrame([(k, [float(v) for v in m]) for k, m in enumerate(masks)], "cand_id long, x array<double>")
    found = {r.cand_id: r for r in nearest.feature_selection_fitness(rows, batch, 4, 5, alpha=0.9, queries=queries, references=references).collect()}
    assert (found[2].n_selected, found[2].score, found[2].fitness) == (0, None, 1.0)
    for k in (0, 1, 3):
        features = [i for i, v in enumerate(masks[k]) if v > 0.5]
        right = Counter()
        for i in range(len(data)):
            others = sorted((float(((data[i, features] - data[j, features]) ** 2).sum()), j) for j in range(len(data)) if folds[j] != folds[i])[:5]
            votes = Counter(labels[j] for _, j in others)
            right[folds[i]] += min(votes, key=lambda c: (-votes[c], c)) == labels[i]
        score = np.mean([right[f] / folds.count(f) for f in range(4)])
        assert found[k].score == pytest.approx(score) and found[k].n_selected == len(features)
        assert found[k].fitness == pytest.approx(0.9 * (1 - score) + 0.1 * len(features) / 6)


def test_other_metrics_and_wrong_arguments(spark, samples):
    rows = samples[0].where("label < 2")
    batch = spark.createDataFrame([(7, [1.0] * 6)], "cand_id long, x array<double>")
    scores = [nearest.feature_selection_fitness(rows, batch, 3, scoring=s).first().score for s in ("accuracy", "f1", "balanced_accuracy")]
    assert len(set(scores)) == 3 and all(0 <= s <= 1 for s in scores)
    for wrong in ({"alpha": 1.5}, {"threshold": 1.0}, {"threshold": -0.1}, {"scoring": "r2"}, {"folds": 1}):
        with pytest.raises(ValueError):
            nearest.feature_selection_fitness(rows, batch, **wrong)
    with pytest.raises(ValueError):
        nearest.feature_selection_fitness(rows, spark.createDataFrame([(7, [1.0] * 5)], "cand_id long, x array<double>"))


def test_a_subset_that_separates_is_better(spark):
    draw = np.random.default_rng(1)
    rows = [(i, i % 2, [float(i % 2) + draw.normal() / 10, *draw.normal(size=4).tolist()]) for i in range(120)]
    batch = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 1.0, 1.0, 1.0]), (2, [1.0] * 5)], "cand_id long, x array<double>")
    found = {r.cand_id: r.fitness for r in nearest.feature_selection_fitness(spark.createDataFrame(rows, "id long, label long, x array<double>"), batch).collect()}
    assert found[0] < found[2] < found[1] and found[0] < 0.01


@pytest.mark.parametrize("scale", [1.0, 1e-8, 1e200])
def test_near_pairs_are_found_whatever_the_rounding(scale):
    rng = np.random.default_rng(3)
    mine, theirs = (np.round(rng.normal(size=(n, 7)), 1) * scale + (1e6 if scale < 1 else 0) for n in (40, 900))
    theirs[:300], folds = theirs[300:600], rng.integers(0, 5, 900)
    other_fold = rng.integers(0, 5, 40)[:, None] != folds[None, :]
    exact = np.where(other_fold, sum((mine[:, None, f] - theirs[None, :, f]) ** 2 for f in range(7)), np.inf)
    for k in (1, 5, 950):
        far = np.full(40, np.inf)
        far[:20] = np.sort(exact, axis=1)[:20, min(k, 900) - 1]
        got = np.zeros(exact.shape, bool)
        got[nearest._near_enough(mine, theirs, k, far, other_fold)] = True
        wanted = (exact <= np.sort(exact, axis=1)[:, min(k, 900) - 1][:, None]) & (exact < np.inf)
        assert not (wanted & ~got).any() and not (got & ~other_fold).any()
        assert scale != 1.0 or k != 5 or got.sum() < 40 * 30  # and few others

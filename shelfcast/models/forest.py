"""Predictions of MLlib tree ensembles on arrays of rows.

MLlib walks all trees for one row after the other, so each row visits the nodes of the whole ensemble in memory.
Here a task takes one tree at a time over many rows; a tree stays in cache, and the comparisons of all trees are
made once per row, since trees share the few thresholds of each feature.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH = 12  # deeper trees are left to MLlib: a full tree has 2 ** depth leaves
ROWS = 4096

_SPLIT = re.compile(r"If \(feature (\d+) <= ([^)]+)\)$")


@dataclass(frozen=True)
class Forest:
    """Full binary trees: the test made in each inner node, numbered from 1 level by level, and the value of each leaf."""

    features: np.ndarray  # of each test
    thresholds: np.ndarray
    tests: list[np.ndarray]
    leaves: list[np.ndarray]
    weights: list[float]
    total: float  # what the weighted sum is divided by

    def predict(self, values: np.ndarray) -> np.ndarray:
        """Prediction per row of ``values`` (rows x features); a missing number goes right, as in MLlib."""
        out = np.empty(len(values))
        for at in range(0, len(values), ROWS):
            rows = values[at:at + ROWS]
            right = (~(rows.T[self.features] <= self.thresholds[:, None])).astype(np.int8).ravel()
            place = np.arange(len(rows))
            found = np.zeros(len(rows))
            for tests, leaves, weight in zip(self.tests, self.leaves, self.weights, strict=True):
                lines = tests * len(rows)
                node = np.ones(len(rows), dtype=np.int64)
                while node[0] < len(leaves):
                    test = lines.take(node)
                    test += place
                    node += node
                    node += right.take(test)
                found += weight * leaves.take(node - len(leaves))
            out[at:at + ROWS] = found / self.total
        return out


def forest_of(model: Model) -> Forest | None:
    """The trees of a fitted regression ensemble; None for other models, very deep trees or splits by category."""
    weights = getattr(model, "treeWeights", None)
    if weights is None or not hasattr(model, "toDebugString"):
        return None
    trees: list[list[tuple[int, float] | float]] = []  # the nodes of a tree, each before its left and right part
    for line in model.toDebugString.splitlines():
        text = line.strip()
        split = _SPLIT.match(text)
        if text.startswith("Tree "):
            trees.append([])
        elif split:
            trees[-1].append((int(split[1]), float(split[2])))
        elif text.startswith("Predict: "):
            trees[-1].append(float(text.removeprefix("Predict: ")))
        elif text.startswith("If "):
            return None
    if not trees or len(trees) != len(weights):
        return None
    number: dict[tuple[int, float], int] = {(0, np.inf): 0}
    tests, leaves = [], []
    for nodes in trees:
        if (depth := _depth(nodes)) > MAX_DEPTH:
            return None
        inner, ends = np.zeros(2 ** depth, dtype=np.int64), np.empty(2 ** depth)
        waiting = [(1, 0)]  # place and level, the next one last
        for node in nodes:
            place, level = waiting.pop()
            if isinstance(node, tuple):
                inner[place] = number.setdefault(node, len(number))
                waiting += [(2 * place + 1, level + 1), (2 * place, level + 1)]
            else:  # all leaves below the place
                below = depth - level
                start = (place << below) - 2 ** depth
                ends[start:start + 2 ** below] = node
        tests.append(inner)
        leaves.append(ends)
    boosted = "GBT" in type(model).__name__
    features, thresholds = zip(*number, strict=True)
    return Forest(np.array(features), np.array(thresholds), tests, leaves, list(weights),
                  1.0 if boosted else float(sum(weights)))


def _depth(nodes: Sequence[tuple[int, float] | float]) -> int:
    deepest, waiting = 0, [0]
    for node in nodes:
        level = waiting.pop()
        deepest = max(deepest, level)
        if isinstance(node, tuple):
            waiting += [level + 1, level + 1]
    return deepest


def forest_prediction(forest: Forest, inputs: Sequence[Column]) -> Column:
    """Prediction column from the ensemble's inputs in order; null counts as a missing number."""

    @F.pandas_udf("double")
    def predict(*columns: pd.Series) -> pd.Series:
        return pd.Series(forest.predict(np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])))

    return predict(*[c.cast("double") for c in inputs])


"""Small models on one bounded training window, used inside a task per version."""

from __future__ import annotations

import numpy as np


def fit_rules(x: np.ndarray, y: np.ndarray, max_rules: int = 6, max_conds: int = 3) -> list[list[float]]:
    """Greedy rules as rows (rule, feature, op, threshold), for one window of rows.

    Same idea as ``rule_search.sequential_covering``, for the many small windows that
    follow drift alarms.
    """
    negative, open_pos = y == 0, y == 1
    total, rows = int(open_pos.sum()), []
    for rule in range(max_rules):
        if open_pos.sum() <= 0.02 * total or not negative.any():
            break
        options = []
        for f in range(x.shape[1]):
            values, centre = x[open_pos, f], x[negative, f].mean()
            op = 1.0 if values.mean() > centre else -1.0
            cuts = np.percentile(values, [10, 25, 50]) - 1e-9 * op
            options += [(f, op, t) for t in {float((values.mean() + centre) / 2), *cuts.tolist()}]
        held = np.array([op * (x[:, f] - t) > 0 for f, op, t in options])
        inside, chosen, best = np.ones(len(y), dtype=bool), [], 0.0
        while len(chosen) < max_conds:
            hit = held & inside
            tp, fp = (hit & open_pos).sum(1), (hit & negative).sum(1)
            score = 2.0 * tp / np.maximum(tp + fp + open_pos.sum(), 1)
            score[[f in {options[c][0] for c in chosen} for f, _, _ in options]] = 0.0
            top = int(np.argmax(score))
            if score[top] <= best + 1e-6:
                break
            best, inside = float(score[top]), hit[top]
            chosen.append(top)
        if not chosen:
            break
        rows += [[float(rule), float(options[c][0]), options[c][1], options[c][2]] for c in chosen]
        open_pos = open_pos & ~inside
    return rows


def predict_rules(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """1 where any rule holds."""
    out = np.zeros(len(x), dtype=bool)
    for rule in np.unique(rows[:, 0]) if len(rows) else []:
        held = np.ones(len(x), dtype=bool)
        for _, f, op, t in rows[rows[:, 0] == rule]:
            held &= (x[:, int(f)] > t) if op > 0 else (x[:, int(f)] < t)
        out |= held
    return out.astype(int)


def _best_split(x: np.ndarray, onehot: np.ndarray) -> tuple[int, float] | None:
    """Split with the lowest weighted Gini impurity."""
    n, best, choice = len(x), np.inf, None
    total = onehot.sum(0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values = x[order, f]
        left = onehot[order].cumsum(0)[:-1]
        usable = values[1:] > values[:-1]
        if not usable.any():
            continue
        size = np.arange(1, n)
        impurity = n - (left**2).sum(1) / size - ((total - left) ** 2).sum(1) / (n - size)
        impurity[~usable] = np.inf
        at = int(np.argmin(impurity))
        if impurity[at] < best - 1e-12:
            best, choice = impurity[at], (f, float((values[at] + values[at + 1]) / 2))
    return choice


def fit_tree(x: np.ndarray, y: np.ndarray, max_depth: int = 8) -> list[list[float]]:
    """Decision tree as rows (feature or -1, threshold, left, right, class)."""
    classes = int(y.max()) + 1 if len(y) else 1
    onehot = np.eye(classes)[y]
    nodes: list[list[float]] = [[]]
    todo = [(0, np.arange(len(y)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        counts = onehot[rows].sum(0)
        pure = counts.max() == len(rows)
        split = None if pure or depth >= max_depth else _best_split(x[rows], onehot[rows])
        if split is None:
            nodes[at] = [-1.0, 0.0, at, at, float(np.argmax(counts))]
            continue
        goes_left = x[rows, split[0]] <= split[1]
        nodes[at] = [float(split[0]), split[1], float(len(nodes)), float(len(nodes) + 1), float(np.argmax(counts))]
        todo += [(len(nodes), rows[goes_left], depth + 1), (len(nodes) + 1, rows[~goes_left], depth + 1)]
        nodes += [[], []]
    return nodes


def predict_tree(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    while True:
        feature = nodes[at, 0].astype(np.int64)
        if (feature < 0).all():
            return nodes[at, 4].astype(int)
        left = x[rows, np.maximum(feature, 0)] <= nodes[at, 1]
        at = np.where(feature < 0, at, np.where(left, nodes[at, 2], nodes[at, 3])).astype(np.int64)


MODELS = {"rules": (fit_rules, predict_rules, 4), "tree": (fit_tree, predict_tree, 5)}

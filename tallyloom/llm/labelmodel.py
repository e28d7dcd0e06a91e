"""Generative models of noisy labellers, fitted by expectation-maximisation on vote patterns.

A pattern is the row of votes that a document got: 0 or 1 for a class, 2 for an abstention. Patterns
with their numbers of documents hold all that the model needs; with m voters there are at most
3 ** m of them, however many documents there are.
"""

from __future__ import annotations

import numpy as np

ABSTAIN = 2


class LabelModel:
    """Shares of kinds of documents and, by kind, what each voter votes.

    ``classes[k]`` is the class, 0 or 1, of the documents of kind k; a class may have several
    kinds, which voters tell apart. With ``parents[j] = -1`` the votes of voter j depend on the kind
    alone. Otherwise they are correlated, within a kind, with the votes of its parent. Where votes are
    correlated, an abstention is a vote too: what a child votes beside it says little without it.
    """

    def __init__(self, n_voters: int, classes: np.ndarray, correlated: bool = False):
        self.parents = [-1] * n_voters
        self.correlated = correlated
        self.classes = np.asarray(classes)
        self.shares = np.full(len(classes), 1 / len(classes))
        self.tables: list[np.ndarray] = []

    def _above(self, votes: np.ndarray, j: int) -> np.ndarray:
        parent = self.parents[j]
        return votes[:, parent] if parent >= 0 else np.zeros(len(votes), np.int64)

    def maximise(self, votes: np.ndarray, weights: np.ndarray) -> None:
        """Set shares and tables from patterns and the documents of each kind with them."""
        total = weights.sum(0) + 1
        self.shares = total / total.sum()
        self.tables = []
        for j in range(votes.shape[1]):
            table = np.full((len(self.classes), 3, 3), 0.1)
            for k in range(len(self.classes)):
                np.add.at(table[k], (self._above(votes, j), votes[:, j]), weights[:, k])
            if self.correlated:
                table /= table.sum(2, keepdims=True)
            else:
                # An abstention says nothing of the kind: it counts for one, like no voter.
                table /= table[:, :, :ABSTAIN].sum(2, keepdims=True)
                table[:, :, ABSTAIN] = 1
            self.tables.append(table)

    def kinds(self, votes: np.ndarray) -> np.ndarray:
        """Probability of each kind for each pattern."""
        joint = np.tile(np.log(self.shares), (len(votes), 1))
        for j in range(votes.shape[1]):
            joint += np.log(self.tables[j][:, self._above(votes, j), votes[:, j]]).T
        joint = np.exp(joint - joint.max(1, keepdims=True))
        return joint / joint.sum(1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each pattern."""
        return self.kinds(votes)[:, self.classes == 1].sum(1)

    def correlate(self, votes: np.ndarray, weights: np.ndarray) -> None:
        """Choose the tree of voter pairs that share the most information within the kinds."""
        n = votes.shape[1]
        shared = np.zeros((n, n))
        for a in range(n):
            for b in range(a):
                for k in range(len(self.classes)):
                    joint = np.full((3, 3), 1e-9)
                    np.add.at(joint, (votes[:, a], votes[:, b]), weights[:, k])
                    part = joint.sum()
                    joint /= part
                    apart = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
                    shared[a, b] += part * (joint * np.log(joint / apart)).sum()
                shared[b, a] = shared[a, b]
        inside = {0} if n else set()
        self.parents = [-1] * n
        while len(inside) < n:
            pairs = ((a, b) for a in inside for b in range(n) if b not in inside)
            a, b = max(pairs, key=lambda pair: shared[pair])
            self.parents[b] = a
            inside.add(b)

    def accuracies(self, votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Estimated share of right votes among each voter's votes."""
        p, out = self.posterior(votes), []
        for v in votes.T:
            cast = v != ABSTAIN
            right = counts * np.where(v == 1, p, 1 - p)
            out.append(right[cast].sum() / max(1, counts[cast].sum()))
        return np.array(out)


def fit(
    votes: np.ndarray,
    counts: np.ndarray,
    start: np.ndarray,
    classes: tuple[int, ...] = (0, 1),
    known: np.ndarray | None = None,
    correlated: bool = False,
    rounds: int = 200,
) -> LabelModel:
    """Fit by EM from ``start``, a first guess of the probability of each kind for each pattern.

    ``known`` holds documents of each kind whose label is given, beside ``counts`` of those whose
    label is not.
    """
    model = LabelModel(votes.shape[1], np.array(classes), correlated)
    known = np.zeros(start.shape) if known is None else known
    p = start.astype(float)
    for step in range(rounds):
        weights = known + counts[:, None] * p
        # Which voters go together is judged once a model without correlations has settled.
        if correlated and step == rounds // 4:
            model.correlate(votes, weights)
        model.maximise(votes, weights)
        new = model.kinds(votes)
        moved, p = np.abs(new - p).max(initial=0), new
        if moved < 1e-7 and not (correlated and step <= rounds // 4):
            break
    return model


def pattern_key(votes: np.ndarray) -> np.ndarray:
    """Rows of votes as one number each."""
    return votes.astype(np.int64) @ (3 ** np.arange(votes.shape[1], dtype=np.int64))


def pattern_votes(keys: np.ndarray, n_voters: int) -> np.ndarray:
    return keys[:, None] // 3 ** np.arange(n_voters, dtype=np.int64) % 3


class SparseRows:
    """Rows of (place, value) pairs, flat."""

    def __init__(self, place: np.ndarray, value: np.ndarray, counts: np.ndarray):
        self.place, self.value = place, value
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.n = len(counts)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.place] * self.value, self.n)

    def back(self, errors: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.place, errors[self.row] * self.value, size)


def train_linear(
    rows: SparseRows, target: np.ndarray, size: int, lasso: float = 0.0, ridge: float = 1e-4, rounds: int = 150
) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets: weights and bias.

    Steps are scaled for each weight by the gradients it has seen; ``lasso`` then draws weights
    to zero, so that features without evidence get none.
    """
    weights, bias = np.zeros(size), 0.0
    seen, seen_bias, rate = np.full(size, 1e-8), 1e-8, 0.5
    for _ in range(rounds):
        score = rows.dot(weights) + bias
        error = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - target) / max(1, rows.n)
        slope, slope_bias = rows.back(error, size) + ridge * weights, error.sum()
        seen += slope**2
        seen_bias += slope_bias**2
        step = rate / np.sqrt(seen)
        weights = weights - step * slope
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * lasso, 0)
        bias -= rate / np.sqrt(seen_bias) * slope_bias
    return weights, bias


def probability(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -40, 40)))

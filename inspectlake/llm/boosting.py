"""Gradient-boosted trees for a few classes, on binned features."""

import numpy as np

BINS = 32


def bin_edges(x, bins=BINS):
    """Borders of about equally full bins for each feature."""
    at = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(column, at)) for column in x.T]


def binned(x, edges):
    return np.stack([np.searchsorted(e, column, side="right") for e, column in zip(edges, x.T)], axis=1).astype(np.uint8)


def _tree(bins, gradient, curvature, depth, least, ridge):
    """(feature, border, value) of a full binary tree of that depth, grown level by level.

    A branch that no split helps gets the border past all bins, so everything goes left.
    """
    n, width = bins.shape
    flat = bins.astype(np.int64) + np.arange(width) * BINS
    feature, border = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 255, np.int64)
    at = np.zeros(n, np.int64)
    for level in range(depth):
        nodes = 2**level
        cell = (at[:, None] * (width * BINS) + flat).ravel()
        g, h = (np.bincount(cell, np.repeat(v, width), minlength=nodes * width * BINS).reshape(nodes, width, BINS) for v in (gradient, curvature))
        g, h = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
        whole_g, whole_h = g[:, :, -1:], h[:, :, -1:]
        gain = g**2 / (h + ridge) + (whole_g - g) ** 2 / (whole_h - h + ridge) - whole_g**2 / (whole_h + ridge)
        gain[(h < least) | (whole_h - h < least)] = 0
        best = gain.reshape(nodes, -1).argmax(axis=1)
        helps = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-6
        first = nodes - 1
        feature[first : first + nodes] = best // BINS
        border[first : first + nodes] = np.where(helps, best % BINS, 255)
        at = 2 * at + (bins[np.arange(n), feature[first + at]] > border[first + at])
    leaves = 2**depth
    g, h = np.bincount(at, gradient, minlength=leaves), np.bincount(at, curvature, minlength=leaves)
    return feature, border, g / (h + ridge)


def _leaf(bins, feature, border, depth):
    """The leaf each row falls into."""
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for level in range(depth):
        k = at + (2**level - 1)
        at = 2 * at + (bins[rows, feature[k]] > border[k])
    return at


def fit(x, y, classes, weight=None, rounds=60, depth=4, rate=0.2, least=2.0, ridge=1.0, drawn=0.4, seed=0):
    """The model: bin borders, and one tree per class and round, as arrays.

    Each tree sees a part (``drawn``) of the rows and of the features.
    """
    rng = np.random.default_rng(seed)
    edges = bin_edges(x)
    bins = binned(x, edges)
    weight = np.ones(len(y)) if weight is None else weight
    share = np.bincount(y, weight, minlength=classes) + 1
    start = np.log(share / share.sum())
    score = np.tile(start, (len(y), 1))
    target = np.eye(classes)[y]
    trees = []
    for _ in range(rounds):
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grown = []
        for c in range(classes):
            rows = np.flatnonzero(rng.random(len(y)) < drawn) if len(y) > 1000 else np.arange(len(y))
            own = np.sort(rng.permutation(x.shape[1])[: max(1, int(drawn * x.shape[1]))])
            q, w = p[rows, c], weight[rows]
            feature, border, value = _tree(bins[np.ix_(rows, own)], w * (target[rows, c] - q), w * q * (1 - q), depth, least, ridge)
            feature = own[feature]
            grown.append((feature, border, rate * value))
            score[:, c] += rate * value[_leaf(bins, feature, border, depth)]
        trees.append(grown)
    return {"edges": edges, "start": start, "trees": trees, "depth": depth}


def log_shares(x, model):
    """Logarithm of the predicted share of each class, one row per row of ``x``."""
    bins = binned(x, model["edges"])
    score = np.tile(model["start"], (len(x), 1))
    for grown in model["trees"]:
        for c, (feature, border, value) in enumerate(grown):
            score[:, c] += value[_leaf(bins, feature, border, model["depth"])]
    top = score.max(axis=1, keepdims=True)
    return score - top - np.log(np.exp(score - top).sum(axis=1, keepdims=True))

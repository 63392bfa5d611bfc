"""Hashed text features and sparse logistic models, shared by the two classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common as C

#: Places of the hashed feature vector.
PLACES = 1 << 18
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_features(texts: pa.Array, prefixes: tuple[int, ...], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, count, bounds, words): of each text the hashed words and word heads with their counts, and its number of words.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, after lower-casing. Words longer than a prefix length also
    count their first so many bytes. With keep, a mask of places, only these are counted.
    """
    raw, at = C.flat(pc.utf8_lower(texts.cast(pa.string()).fill_null("")))
    solid = _WORD[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    first[at[at < len(raw)]] = solid[at[at < len(raw)]]
    edge = at[1:][at[1:] > 0] - 1
    last[edge] = solid[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    s, inverse = C.rolling(raw), C.powers(len(raw) + 1)[1]
    text = np.searchsorted(at, starts, "right") - 1
    places, owners = [], []
    for p in (0, *prefixes):
        who = np.flatnonzero(ends - starts > p)
        stop = ends[who] if p == 0 else starts[who] + p
        h = C.mixed((s[stop] - s[starts[who]]) * inverse[starts[who]] + np.uint64(p))
        place = (h >> np.uint64(46)).astype(np.int64)
        if keep is not None:
            who, place = who[keep[place]], place[keep[place]]
        places.append(place)
        owners.append(text[who])
    key = np.concatenate(owners) * PLACES + np.concatenate(places)
    key, count = np.unique(key, return_counts=True)
    bounds = np.searchsorted(key, np.arange(len(at)) * PLACES)
    return key % PLACES, count, bounds, np.bincount(text, minlength=len(texts))


def chosen(place: np.ndarray, value: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows without the places that are not kept."""
    some = keep[place]
    return place[some], value[some], np.append(0, np.cumsum(some))[bounds]


def dot(weights: np.ndarray, place: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Products of sparse rows with the weights."""
    total = np.cumsum(np.append(0.0, weights[place] * value))
    return total[bounds[1:]] - total[bounds[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(place: np.ndarray, value: np.ndarray, bounds: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float, twin: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, fairness: float = 0.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model by full-batch Adam: mean weighted cross-entropy, ridge * |w|^2 and fairness times the mean squared difference of a row's score from its twin's."""
    used, inner = np.unique(np.concatenate([place, twin[0]]) if twin else place, return_inverse=True)
    own, other = inner[: len(place)], inner[len(place) :]
    row = np.repeat(np.arange(len(target)), np.diff(bounds))
    far = np.repeat(np.arange(len(target)), np.diff(twin[2])) if twin else row
    w, b = np.zeros(len(used)), float(np.log((target @ weight + 1) / ((1 - target) @ weight + 1)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    total = weight.sum()
    for t in range(1, steps + 1):
        score = sigmoid(dot(w, own, value, bounds) + b)
        error = weight * (score - target) / total
        if twin and len(target):
            changed = sigmoid(dot(w, other, twin[1], twin[2]) + b)
            slope = 2 * fairness / len(target) * (score - changed)
            error, back = error + slope * score * (1 - score), slope * changed * (1 - changed)
        g = np.bincount(own, value * error[row], minlength=len(used)) + 2 * ridge * w
        gb = error.sum()
        if twin and len(target):
            g -= np.bincount(other, twin[1] * back[far], minlength=len(used))
            gb -= back.sum()
        rate = 0.1 * (1 - (t - 1) / steps)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    full = np.zeros(PLACES)
    full[used] = w
    return full, b

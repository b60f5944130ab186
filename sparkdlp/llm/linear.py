"""Sparse logistic regression on hashed features, with calibration: small numpy helpers of the classifiers."""

from __future__ import annotations

import numpy as np

from sparkdlp.llm.common import mix, span_hashes, utf8, word_spans

#: Hash slots of the text features.
SLOTS = 1 << 16
#: Features that one step of the fit holds at a time.
STEP = 1 << 20

Rows = list[tuple[np.ndarray, np.ndarray]]


def weighted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and damped counts, scaled to length one."""
    ordered = np.sort((codes & np.uint64(SLOTS - 1)).astype(np.uint16), kind="stable")  # by radix
    ends = np.append(np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, len(ordered)) if len(ordered) else np.zeros(0, np.int64)
    begins = np.append(0, ends[:-1])[: len(ends)]
    counts = ends - begins
    values = np.log1p(counts).astype(np.float32)
    length = float(np.sqrt((values * values).sum())) or 1.0
    return ordered[begins].astype(np.int32), values / np.float32(length)


def characters(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes."""
    if not len(data) or data.max() < 128:
        return data.astype(np.uint64)
    wide = data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass")
    return np.frombuffer(wide, dtype="<u4").astype(np.uint64)


def text_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, word pairs and runs of four characters of a whole text."""
    with np.errstate(over="ignore"):
        step = np.uint64(0x9E3779B97F4A7C15)
        words = span_hashes(data, starts, ends)
        pairs = mix(words[:-1] * step + words[1:]) if len(words) > 1 else words[:0]
        points = characters(data)
        runs = ((points[:-3] * step + points[1:-2]) * step + points[2:-1]) * step + points[3:] if len(points) > 3 else points[:0]
        return weighted(np.concatenate([words, pairs, mix(runs)]))


def features_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    data = utf8(text)
    return text_features(data, *word_spans(data))


def raw_score(model: np.ndarray, at: np.ndarray, values: np.ndarray) -> float:
    """The last entry of a model is its intercept."""
    return float(model[at] @ values + model[-1])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: Rows, labels: np.ndarray, slots: int = SLOTS, rounds: int = 80, rate: float = 0.3, ridge: float = 1e-5) -> np.ndarray:
    """Weights of a logistic regression by full-batch Adam; classes weigh alike. Without two classes: zeros."""
    model = np.zeros(slots + 1, dtype=np.float64)
    labels = np.asarray(labels, dtype=np.float64)
    if not len(labels) or labels.min() == labels.max():
        return model
    rows = [(at, v) if len(at) else (np.zeros(1, np.int32), np.zeros(1, np.float32)) for at, v in rows]
    weight = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    # Rows in blocks of about STEP features, so that the steps need little memory beside the rows.
    block = np.cumsum([len(at) for at, _ in rows]) // STEP
    blocks = []
    for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(block)) + 1):
        sizes = np.asarray([len(rows[i][0]) for i in part])
        at, values = (np.concatenate([rows[i][side] for i in part]) for side in (0, 1))
        blocks.append((at, values, sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]]), labels[part], weight[part]))
    first, second = np.zeros_like(model), np.zeros_like(model)
    for turn in range(1, rounds + 1):
        slope = ridge * model
        for at, values, sizes, begin, truth, share in blocks:
            scores = np.add.reduceat(model[at] * values, begin) + model[-1]
            error = (sigmoid(scores) - truth) * share
            slope[:-1] += np.bincount(at, weights=np.repeat(error, sizes) * values, minlength=slots)
            slope[-1] += error.sum()
        slope[-1] -= ridge * model[-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        model -= rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
    return model


def calibrate(scores: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights that turn columns of scores into log odds of the label (last: intercept), by damped Newton steps."""
    scores = np.atleast_2d(np.asarray(scores, dtype=np.float64).T).T
    design = np.column_stack([scores, np.ones(len(scores))])
    labels = np.asarray(labels, dtype=np.float64)
    out = np.zeros(design.shape[1])
    if not len(labels):
        return out
    # Smoothed targets keep separable scores finite.
    good, bad = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    for _ in range(60):
        p = sigmoid(design @ out)
        slope = design.T @ (p - target) + 1e-3 * out
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(design.shape[1])
        step = np.linalg.solve(curve, slope)
        out -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return out


def calibrated(weights: np.ndarray, *scores):
    return sigmoid(sum(w * s for w, s in zip(weights[:-1], scores, strict=True)) + weights[-1])

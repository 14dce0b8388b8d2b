"""Quality classifier: Naive Bayes support vectors.

Indicators of character-class, byte and word n-grams are scaled by their class
log-count ratios; a linear hinge-loss model is fitted to them by dual
coordinate descent and its margins are turned into probabilities.

Defined results: null and empty texts have no n-grams and get the score of the
bias; repeated rows each get their row; with labels of one class only or none
every score is the smoothed share of that class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.llm.arrow import map_batches
from skylattice.llm.common import labelled, one_text_each
from skylattice.llm.textkit import SOLID, groups, mix, word_hashes

#: Indicators: 2^16 for four character classes in a row (those that would begin with a 15th class: for three
#: words in a row, which of the last three words each repeats), 2^16 for three bytes, 2^17 for one and two words.
SIZE = 1 << 18
CLASSES = np.array([0 if chr(b) in " \t\r" else 1 if b == 10 else 2 if chr(b).isdigit() else 3 if 65 <= b <= 90 else 4 if 97 <= b <= 122 else 5 if b >= 128 else 6 + "#*$%&|<>!?.,;:".find(chr(b)) // 2 if chr(b) in "#*$%&|<>!?.,;:" else 14 for b in range(256)], np.uint32)


def indicators(texts: list[str | None]) -> list[np.ndarray]:
    """The active indicators of each text, sorted."""
    out: list[np.ndarray] = []
    flags = np.zeros(SIZE, bool)
    for _, _, buf, at in groups([t or "" for t in texts]):
        h, starts, _, b = word_hashes(buf, SOLID)
        one = (h >> np.uint64(47)).astype(np.int64) + (1 << 17)
        two = (mix(h[:-1] * np.uint64(3) + h[1:]) >> np.uint64(47)).astype(np.int64) + (1 << 17)
        c, x = CLASSES[b], b.astype(np.uint32)
        c4 = (c[:-3] << 12) | (c[1:-2] << 8) | (c[2:-1] << 4) | c[3:]
        b3 = ((x[:-2] * np.uint32(2654435761) + x[1:-1] * np.uint32(40503) * np.uint32(65599) + x[2:] * np.uint32(2246822519)) >> np.uint32(16)) + np.uint32(1 << 16)
        word_at = np.searchsorted(starts, at)
        again = np.zeros(len(h), np.int64)
        for back in (1, 2, 3):
            again[back:] |= (h[back:] == h[:-back]).astype(np.int64) << (back - 1)
        again = (15 << 12) + (again[:-2] << 6 | again[1:-1] << 3 | again[2:])
        for k in range(len(at) - 1):
            lo, hi, wl, wh = at[k], at[k + 1] - 1, word_at[k], word_at[k + 1]
            flags[c4[lo : max(lo, hi - 3)]] = True
            flags[b3[lo : max(lo, hi - 2)]] = True
            flags[one[wl:wh]] = True
            flags[two[wl : max(wl, wh - 1)]] = True
            flags[again[wl : max(wl, wh - 2)]] = True
            active = np.flatnonzero(flags)
            flags[active] = False
            out.append(active)
    return out


def dual_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Hinge-loss weights on indicators scaled by ``ratio`` (and a bias), one dual variable at a time.

    Vectors are brought to unit length, so texts of all lengths weigh the same.
    """
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    values = [unit(ratio[r]) for r in rows]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            gradient = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / (v @ v + 1.0), 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            alpha[i] = new
            if step:
                w[r] += step * v
                bias += step
    return w, bias


def unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt(v @ v)
    return v / n if n else v


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to probabilities, by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    t = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        t -= np.linalg.solve(h, x.T @ (p - target) + 1e-3 * t)
    return float(max(t[0], 1e-6)), float(t[1])


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weight[r] @ unit(self.ratio[r]) + self.bias for r in rows])

    def scores(self, texts: list[str | None]) -> list[float]:
        return (1 / (1 + np.exp(-np.clip(self.slope * self.margins(indicators(texts)) + self.offset, -30, 30)))).tolist()


def fit_rows(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0, cost: float = 4.0) -> Model:
    """Model of labelled indicator rows (y 0/1); a fifth of them is kept aside for the probabilities."""
    sign = np.where(y > 0, 1.0, -1.0)
    if len(set(sign)) < 2:
        share = (float((y > 0).sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 1.0, float(np.log(share / (1 - share))))

    def train(keep: np.ndarray) -> Model:
        counts = {s: np.full(SIZE, smooth) for s in (1.0, -1.0)}
        for i in np.flatnonzero(keep):
            counts[sign[i]][rows[i]] += 1
        ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
        idx = np.flatnonzero(keep)
        share = np.array([(sign[idx] == s).mean() for s in sign[idx]])
        w, b = dual_descent([rows[i] for i in idx], ratio, sign[idx], cost / (2 * np.maximum(share, 1e-9)))
        return Model(ratio, w, b, 1.0, 0.0)

    aside = np.arange(len(rows)) % 5 == 4
    if len(set(sign[~aside])) == 2 and aside.any():
        slope, offset = platt(train(~aside).margins([rows[i] for i in np.flatnonzero(aside)]), sign[aside])
    else:
        slope, offset = 1.0, 0.0
    m = train(np.ones(len(rows), bool))
    m.slope, m.offset = slope, offset
    return m


def fit(docs: DataFrame, labels: DataFrame, usable: Column, max_labels: int = 4000) -> Model:
    """Model from a bounded sample (``max_labels``) of the usable labelled rows: their indicators come to the driver, 4 bytes each."""
    ids = labelled(labels.select("doc_id", "quality"), "quality", usable, max_labels)
    sample = one_text_each(docs, ids).select("doc_id", "y", "text")

    def make():
        return lambda c: {"doc_id": c["doc_id"], "y": c["y"], "active": [r.astype(np.int32).tobytes() for r in indicators(c["text"])]}

    got = map_batches(sample, make, "doc_id long, y int, active binary").toArrow().to_pydict()
    order = sorted(range(len(got["y"])), key=lambda i: (got["doc_id"][i] * 2654435761 % 4294967296, got["active"][i]))
    rows = [np.frombuffer(got["active"][i], np.int32).astype(np.int64) for i in order]
    return fit_rows(rows, np.array([got["y"][i] for i in order]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of the whole text, for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda c: {"doc_id": c["doc_id"], "score": shared.value.scores(c["text"])}

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, score double")

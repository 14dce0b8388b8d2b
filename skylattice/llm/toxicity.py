"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Every word enters as a hashed word vector, its class log-count ratio and the
mean of hashed vectors of its character trigrams, with the highest ratio of
its character four-grams.  Two gated recurrent passes give every word a state;
an attention pool over the states of a window of words makes one probability.
All overlapping windows of a whole text, one from every word on, are scored and
the highest one counts.

The passes run over blocks of words, each from CONTEXT words outside its block
on, so their cost is linear in the text and long texts are worked on side by
side; the windows then share the states, and differ in their pools alone.
Training is plain numpy on a bounded sample of labelled texts.  The ratios are
two of the inputs of a word; with them set to zero the network still learns
from the vectors alone (a test), but needs more labelled texts for it.

Defined results: null and empty texts have one empty window; repeated rows each
get their row; with labels of one class only or none every score is the
smoothed share of that class.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.llm.arrow import map_batches
from skylattice.llm.common import labelled, one_text_each, store
from skylattice.llm.nbsvm import platt
from skylattice.llm.textkit import LETTERS, groups, word_hashes

#: Words of a window; words that a pass runs over before it reaches a block; words of a block.
WINDOW, CONTEXT, BODY = 12, 8, 40
WORDS, TRIGRAMS = 1 << 15, 1 << 13
D_WORD, D_CHAR, HIDDEN, ATTEND = 8, 8, 8, 8
#: Inputs of a word: its vector, its ratio, the highest ratio of its four-grams, its character vector.
RATIO, CHAR_RATIO, D_IN = D_WORD, D_WORD + 1, D_WORD + 2 + D_CHAR
#: Blocks of words that go through the network together.
BLOCK = 4096
RATIO_BITS = 18


@dataclass
class Tokens:
    """Words of some texts: per text the range of its words; per distinct word its hash and its trigrams and four-grams of bytes."""

    bounds: np.ndarray
    ids: np.ndarray
    hashes: np.ndarray
    trigrams: np.ndarray
    fours: np.ndarray
    trigram_at: np.ndarray


def tokenize(buf: bytes, at: np.ndarray) -> Tokens:
    h, starts, ends, b = word_hashes(buf, LETTERS)
    hashes, first, ids = np.unique(h, return_index=True, return_inverse=True)
    s, size = starts[first], (ends - starts)[first]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)
    at_byte, length = np.repeat(s, size) + place, np.repeat(size, size)

    def near(shift: int) -> np.ndarray:  # what lies outside the word counts as a space
        inside = (place + shift >= 0) & (place + shift < length)
        return np.where(inside, b[np.clip(at_byte + shift, 0, len(b) - 1)], 32).astype(np.uint32)

    three = near(-1) * np.uint32(2654435761) + near(0) * np.uint32(2246822519) + near(1) * np.uint32(3266489917)
    four = (three ^ (three >> np.uint32(15))) * np.uint32(0x85EBCA6B) + near(2) * np.uint32(0xC2B2AE35)
    return Tokens(np.searchsorted(starts, at), ids.astype(np.int64), hashes, (three >> np.uint32(19)).astype(np.int64), (four >> np.uint32(32 - RATIO_BITS)).astype(np.int64), offsets)


def windows(n: int) -> np.ndarray:
    """Starts of the overlapping windows of n words: every word that has WINDOW words from it on."""
    return np.arange(max(1, n - WINDOW + 1), dtype=np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    p: dict[str, np.ndarray]
    ratio: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(1 << RATIO_BITS, np.float32),) * 2)
    slope: float = 1.0
    offset: float = 0.0

    @staticmethod
    def fresh(seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        d = D_IN
        w = lambda *s, k=0.3: (rng.normal(size=s) * k).astype(np.float32)
        p = {"word": w(WORDS, D_WORD, k=0.05), "char": w(TRIGRAMS, D_CHAR, k=0.05), "att": w(2 * HIDDEN, ATTEND), "att_v": w(ATTEND), "out": w(2 * HIDDEN), "out_b": np.zeros(1, np.float32)}
        for side in "fb":
            p |= {f"in_{side}": w(d, 3 * HIDDEN), f"in_b_{side}": np.zeros(3 * HIDDEN, np.float32), f"rec_{side}": w(HIDDEN, 3 * HIDDEN), f"rec_b_{side}": np.zeros(HIDDEN, np.float32)}
        return Network(p)

    def inputs(self, t: Tokens) -> np.ndarray:
        """One row per distinct word, and a zero row at the end for padding."""
        x = np.zeros((len(t.hashes) + 1, D_IN), np.float32)
        if len(t.hashes):
            x[:-1, :D_WORD] = self.p["word"][(t.hashes & np.uint64(WORDS - 1)).astype(np.int64)]
            x[:-1, RATIO] = self.ratio[0][(t.hashes >> np.uint64(64 - RATIO_BITS)).astype(np.int64)]
            x[:-1, CHAR_RATIO] = np.maximum.reduceat(self.ratio[1][t.fours], t.trigram_at[:-1])
            x[:-1, CHAR_RATIO + 1 :] = np.add.reduceat(self.p["char"][t.trigrams], t.trigram_at[:-1], axis=0) / np.diff(t.trigram_at)[:, None]
        return x

    def forward(self, x: np.ndarray, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict | None]:
        """Logits of windows: ``ids`` [n, CONTEXT + WINDOW + CONTEXT] are rows of ``x``; the last row of x is padding and passes the state on."""
        n, steps = ids.shape
        real = (ids != len(x) - 1).T[:, :, None]
        h_all = np.zeros((steps, n, 2 * HIDDEN), x.dtype)
        cache: dict = {"real": real}
        for side, order in (("f", range(steps - CONTEXT)), ("b", range(steps - 1, CONTEXT - 1, -1))):
            pre = x @ self.p[f"in_{side}"] + self.p[f"in_b_{side}"]
            rec, rb = self.p[f"rec_{side}"], self.p[f"rec_b_{side}"]
            h = np.zeros((n, HIDDEN), x.dtype)
            cut = slice(0, HIDDEN) if side == "f" else slice(HIDDEN, None)
            for t in order:
                a, u = pre[ids[:, t]], h @ rec
                zr = sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                un = u[:, 2 * HIDDEN :] + rb
                c = np.tanh(a[:, 2 * HIDDEN :] + r * un)
                new = np.where(real[t], z * h + (1 - z) * c, h)
                if keep:
                    cache[side, t] = (h, z, r, un, c)
                h_all[t, :, cut] = h = new
        e = np.tanh(h_all @ self.p["att"])
        own = real[:, :, 0] & ((np.arange(steps) >= CONTEXT) & (np.arange(steps) < steps - CONTEXT))[:, None]
        s = np.where(own, e @ self.p["att_v"], np.float32(-1e9))
        s = np.exp(s - s.max(0))
        s /= s.sum(0)
        pooled = np.einsum("tn,tnd->nd", s, h_all)
        logit = pooled @ self.p["out"] + self.p["out_b"]
        if keep:
            cache |= {"h": h_all, "e": e, "s": s, "pooled": pooled, "own": own}
        return logit, cache if keep else None

    def word_parts(self, t: Tokens, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Attention score and contribution to the logit of every word of some texts, both passes in one product a step."""
        first = np.concatenate([np.arange(lo, hi, BODY) for lo, hi in zip(t.bounds[:-1], t.bounds[1:], strict=True)])
        text = np.repeat(np.arange(len(t.bounds) - 1), -(-np.diff(t.bounds) // BODY))
        score, value = np.zeros(len(t.ids)), np.zeros(len(t.ids))
        pre = np.concatenate([x @ self.p[f"in_{side}"] + self.p[f"in_b_{side}"] for side in "fb"], 1).reshape(-1, 2, 3 * HIDDEN)
        rec = np.stack([self.p["rec_f"], self.p["rec_b"]])
        rb = np.stack([self.p["rec_b_f"], self.p["rec_b_b"]])[:, None]
        for k in range(0, len(first), BLOCK):
            at = first[k : k + BLOCK, None] + np.arange(-CONTEXT, BODY + CONTEXT)
            lo, hi = (t.bounds[text[k : k + BLOCK] + i][:, None] for i in (0, 1))
            real = (at >= lo) & (at < hi)
            ids = np.where(real, t.ids[np.clip(at, 0, len(t.ids) - 1)], len(t.hashes))
            h = np.zeros((2, len(at), HIDDEN), np.float32)
            states = np.zeros((BODY, len(at), 2 * HIDDEN), np.float32)
            for i in range(CONTEXT + BODY):
                j = ids.shape[1] - 1 - i
                a, u = np.stack([pre[ids[:, i], 0], pre[ids[:, j], 1]]), h @ rec
                zr = sigmoid(a[:, :, : 2 * HIDDEN] + u[:, :, : 2 * HIDDEN])
                c = np.tanh(a[:, :, 2 * HIDDEN :] + zr[:, :, HIDDEN:] * (u[:, :, 2 * HIDDEN :] + rb))
                new = c + zr[:, :, :HIDDEN] * (h - c)
                h = np.where(np.stack([real[:, i], real[:, j]])[:, :, None], new, h)
                if i >= CONTEXT:
                    states[i - CONTEXT, :, :HIDDEN] = h[0]
                    states[j - CONTEXT, :, HIDDEN:] = h[1]
            body = real[:, CONTEXT : CONTEXT + BODY].T
            where = at[:, CONTEXT : CONTEXT + BODY].T[body]
            states = states[body]
            score[where] = np.tanh(states @ self.p["att"]) @ self.p["att_v"]
            value[where] = states @ self.p["out"]
        return score, value

    def window_logits(self, score: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Logits of all windows of one text from the parts of its words."""
        if not len(score):
            return self.p["out_b"].astype(float)
        share = np.exp(score - score.max())
        k = min(WINDOW, len(score))
        over = lambda v: np.lib.stride_tricks.sliding_window_view(v, k).sum(1)
        return over(share * value) / over(share) + self.p["out_b"][0]

    def backward(self, x: np.ndarray, ids: np.ndarray, cache: dict, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the dense parameters and of the rows of ``x``."""
        p, g = self.p, {}
        h_all, e, s, real, own = cache["h"], cache["e"], cache["s"], cache["real"], cache["own"]
        steps = len(h_all)
        g["out"], g["out_b"] = cache["pooled"].T @ d_logit, d_logit.sum(keepdims=True)
        d_pool = d_logit[:, None] * p["out"]
        d_s = np.einsum("nd,tnd->tn", d_pool, h_all)
        d_score = s * (d_s - (s * d_s).sum(0)) * own
        d_e = d_score[:, :, None] * p["att_v"] * (1 - e * e)
        g["att_v"] = np.einsum("tn,tna->a", d_score, e)
        g["att"] = np.einsum("tnd,tna->da", h_all, d_e)
        d_h_all = s[:, :, None] * d_pool + d_e @ p["att"].T
        d_x = np.zeros_like(x)
        for side, order in (("f", range(steps - CONTEXT - 1, -1, -1)), ("b", range(CONTEXT, steps))):
            rec = p[f"rec_{side}"]
            cut = slice(0, HIDDEN) if side == "f" else slice(HIDDEN, None)
            d_pre = np.zeros((len(x), 3 * HIDDEN), np.float32)
            d_rec, d_rb = np.zeros_like(rec), np.zeros(HIDDEN, np.float32)
            d_h = np.zeros((ids.shape[0], HIDDEN), np.float32)
            for t in order:
                h, z, r, un, c = cache[side, t]
                d = d_h + d_h_all[t][:, cut]
                live = d * real[t]
                d_c = live * (1 - z) * (1 - c * c)
                d_z = live * (h - c) * z * (1 - z)
                d_r = d_c * un * r * (1 - r)
                d_a = np.concatenate([d_z, d_r, d_c], 1)
                d_u = np.concatenate([d_z, d_r, d_c * r], 1)
                np.add.at(d_pre, ids[:, t], d_a)
                d_rec += h.T @ d_u
                d_rb += (d_c * r).sum(0)
                d_h = d_u @ rec.T + live * z + d * ~real[t]
            g |= {f"rec_{side}": d_rec, f"rec_b_{side}": d_rb, f"in_{side}": x.T @ d_pre, f"in_b_{side}": d_pre.sum(0)}
            d_x += d_pre @ p[f"in_{side}"].T
        return g, d_x

    def window_ids(self, t: Tokens, k: int, starts: np.ndarray) -> np.ndarray:
        """Word rows of windows of text k, with the words around them."""
        lo, hi = t.bounds[k], t.bounds[k + 1]
        at = lo + starts[:, None] + np.arange(-CONTEXT, WINDOW + CONTEXT)
        return np.where((at >= lo) & (at < hi), t.ids[np.clip(at, 0, len(t.ids) - 1)] if len(t.ids) else 0, len(t.hashes))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The highest window logit of each text."""
        out = np.zeros(len(texts))
        for first, last, buf, at in groups([(x or "").lower() for x in texts]):
            t = tokenize(buf, at)
            score, value = self.word_parts(t, self.inputs(t))
            for k in range(last - first):
                own = slice(t.bounds[k], t.bounds[k + 1])
                out[first + k] = self.window_logits(score[own], value[own]).max()
        return out

    def scores(self, texts: list[str | None]) -> list[float]:
        return sigmoid(np.clip(self.slope * self.logits(texts) + self.offset, -30, 30)).tolist()


def log_ratios(tokens: list[Tokens], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class log-count ratios of hashed words and of four-grams, by the texts that hold them, in units of about one."""

    def ratio_of(sets: list[np.ndarray]) -> np.ndarray:
        counts = {c: np.ones(1 << RATIO_BITS) for c in (0, 1)}
        for s, c in zip(sets, y, strict=True):
            counts[int(c)][np.unique(s)] += 1
        ratio = np.log(counts[1] / ((y > 0).sum() + 2)) - np.log(counts[0] / ((y == 0).sum() + 2))
        return np.where(counts[0] + counts[1] > 3, np.clip(ratio / 3, -1.0, 2.5), 0.0).astype(np.float32)

    return ratio_of([(t.hashes >> np.uint64(64 - RATIO_BITS)).astype(np.int64) for t in tokens]), ratio_of([t.fours for t in tokens])


def train(texts: list[str], y: np.ndarray, epochs: int = 6, seed: int = 11) -> Network:
    """Multiple-instance training: a text's highest window carries its label, and clean texts give further windows.

    The word ratios of each half of the texts come from the other half, so
    that a training text never meets a ratio made from its own label; the
    last texts of the order are kept aside for the probabilities.
    """
    net = Network.fresh()
    if len(set(y.tolist())) < 2:
        share = (float((y > 0).sum()) + 1) / (len(y) + 2)
        net.p["out"][:] = 0
        net.offset = float(np.log(share / (1 - share)))
        return net
    rng = np.random.default_rng(seed)
    tokens = [tokenize((x or "").lower().encode("utf-8", "replace") + b" ", np.array([0, 1 << 60])) for x in texts]
    fold = np.arange(len(texts)) % 2
    ratios = [log_ratios([tokens[i] for i in np.flatnonzero(fold != f)], y[fold != f]) for f in (0, 1)]
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    tick = 0
    aside = np.arange(len(texts)) % 6 >= 4
    use = np.flatnonzero(~aside)
    pos, neg = use[y[use] > 0], use[y[use] == 0]
    for epoch in range(epochs):
        rate = 0.01 * 0.6**epoch
        batch_neg = rng.permutation(neg)
        batch_pos = rng.permutation(np.resize(pos, max(len(pos), len(neg) // 3)))
        step_pos, step_neg = 24, 72
        for b in range(0, len(batch_neg), step_neg):
            k = b // step_neg * step_pos
            rows = np.concatenate([batch_neg[b : b + step_neg], batch_pos[k : k + step_pos]])
            x_parts, ids_parts, label, base, pads = [], [], [], 0, []
            owners = []
            for i in rows:
                net.ratio = ratios[fold[i]]
                t = tokens[i]
                x = net.inputs(t)
                starts = windows(len(t.ids))
                if epoch == 0 and y[i]:  # before the network knows anything, the ratios point at the window
                    word = x[net.window_ids(t, 0, starts)[:, CONTEXT:-CONTEXT], RATIO : CHAR_RATIO + 1]
                    z = word.max((1, 2)) + 0.1 * word.sum((1, 2))
                else:
                    z = net.window_logits(*net.word_parts(t, x)) if len(starts) > 1 else np.zeros(1)
                chosen = np.array([int(z.argmax())] + ([int(rng.integers(len(starts)))] if not y[i] and len(starts) > 1 else []))
                ids = net.window_ids(t, 0, chosen)
                pads.append(base + len(x) - 1)
                x_parts.append(x)
                owners.append(t)
                ids_parts.extend(ids + base)
                label.extend([y[i]] * len(ids))
                base += len(x)
            x, ids, target = np.concatenate(x_parts), np.array(ids_parts), np.array(label, np.float32)
            x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
            ids = np.where(np.isin(ids, pads), len(x) - 1, ids)
            logit, cache = net.forward(x, ids, True)
            weight = np.where(target > 0, (target == 0).sum() / max(1, (target > 0).sum()), 1.0)
            d_logit = ((sigmoid(logit) - target) * weight / weight.sum()).astype(np.float32)
            g, d_x = net.backward(x, ids, cache, d_logit)
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            row = 0
            for t, part in zip(owners, x_parts, strict=True):
                d = d_x[row : row + len(part) - 1]
                np.add.at(g["word"], (t.hashes & np.uint64(WORDS - 1)).astype(np.int64), d[:, :D_WORD])
                if len(d):
                    size = np.diff(t.trigram_at)
                    np.add.at(g["char"], t.trigrams, np.repeat(d[:, CHAR_RATIO + 1 :] / size[:, None], size, axis=0))
                row += len(part)
            tick += 1
            for name, grad in g.items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                net.p[name] -= (rate * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.99**tick)) + 1e-6)).astype(np.float32)
    logits = np.zeros(len(texts))
    for f in (0, 1):
        net.ratio = ratios[f]
        own = np.flatnonzero(fold == f)
        logits[own] = net.logits([texts[i] for i in own])
    held = np.flatnonzero(aside)
    if len(set(y[held].tolist())) == 2:
        net.slope, net.offset = platt(logits[held], np.where(y[held] > 0, 1.0, -1.0))
    net.ratio = log_ratios(tokens, y)
    return net


def choose(size: list[int], y: list[int], bound: int) -> list[int]:
    """Places of the texts to fit on, in order, of at most ``bound`` characters together.

    A text over a sixteenth of the bound, or over what is left of it, is
    passed over and the next one tried.  Each class first gets up to half of
    the bound; the rest goes to whoever comes next.  A class that has only
    long texts keeps its shortest one if that fits its half.
    """
    kept: set[int] = set()
    total = 0
    for c in (0, 1):
        own, used = [i for i in range(len(size)) if y[i] == c], 0
        small = [i for i in own if size[i] <= bound // 16] or sorted(own, key=lambda i: size[i])[:1]
        for i in small:
            if used + size[i] <= bound // 2:
                used += size[i]
                kept.add(i)
        total += used
    for i in range(len(size)):
        if i not in kept and size[i] <= bound // 16 and total + size[i] <= bound:
            total += size[i]
            kept.add(i)
    return sorted(kept)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, max_labels: int = 3000, max_chars: int = 8_000_000) -> Network:
    """Network from a bounded sample: ``max_labels`` usable labelled rows, of which those that ``choose`` takes in hash order.

    Lengths come to the driver first, one an id, the texts of the chosen rows
    only then.
    """
    ids = labelled(labels.select("doc_id", "toxic"), "toxic", usable, max_labels)
    part = store(one_text_each(docs, ids).select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text")), "toxicity-sample")
    seen = part.select("doc_id", "y", F.length("text").alias("size")).collect()
    seen.sort(key=lambda r: (r.doc_id * 2654435761 % 4294967296, r.doc_id))
    keys = [(seen[i].doc_id,) for i in choose([r.size for r in seen], [r.y for r in seen], max_chars)]
    chosen = docs.sparkSession.createDataFrame(keys, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    got = part.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").toArrow().to_pydict()
    place = {k[0]: i for i, k in enumerate(keys)}
    order = sorted(range(len(got["y"])), key=lambda i: place[got["doc_id"][i]])
    return train([got["text"][i] for i in order], np.array([got["y"][i] for i in order]))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of the whole text, for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        return lambda c: {"doc_id": c["doc_id"], "score": shared.value.scores(c["text"])}

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, score double")

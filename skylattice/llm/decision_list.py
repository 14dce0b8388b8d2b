"""Quality rules: a decision list learned by sequential covering.

Text statistics are DataFrame expressions; from labelled ones, rules (threshold
conjunctions that mark good or bad text) are grown by FOIL gain, pruned on
held-back rows, and emitted as one ordered CASE expression: the first rule that
holds decides, so a rule for good text shields what it covers from later rules
for bad text.

Defined results: null text counts as empty; an empty text fails the base test;
repeated rows each get their row; with no usable labels the list is empty and
only the base test decides; what no rule covers is kept, unless nearly all
labelled rows left over are bad.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import labelled, let, one_text_each

SPACES = r"[\x20\x09-\x0D]+"
#: Statistics that rules may test; every one is a ratio or a mean, so texts of all lengths compare.
FEATURES = ("mean_word", "symbols", "dup_lines", "repeats", "upper", "bangs", "stops", "digits", "line_words")


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice.

    Windows are compared by 64-bit hash within one text.  Equal neighbours in
    sorted order tell which hashes repeat; only then are positions looked at.
    """
    n = F.size(words)
    hashes = F.when(n >= 4, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def places(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda p: F.filter(p, lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))))
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(at, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(places(h)))


def text_stats(text: Column) -> Column:
    """Struct of the base statistics and the learnable ones."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, SPACES, -1), "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    gone = lambda pattern: (F.char_length(t) - F.char_length(F.regexp_replace(t, pattern, ""))).cast("bigint")

    def build(w: Column) -> Column:
        return let(lines, lambda x: F.struct(
            F.size(w).cast("bigint").alias("n_words"), F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"), gone("[#*$%&|<>]+").alias("n_symbols"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"), repeated_words(w).alias("n_repeat_words"),
            F.size(x).cast("bigint").alias("n_lines"), gone(r"\p{Lu}+").alias("n_upper"), gone("[!?]+").alias("n_bangs"), gone("[.,;:]+").alias("n_stops"), gone("[0-9]+").alias("n_digits"),
        ))

    return let(words, build)


def features(s: Column) -> dict[str, Column]:
    """The learnable ratios of a statistics struct; 0 for a text without words."""
    per = lambda a, b: F.when(s[b] > 0, s[a].cast("double") / s[b]).otherwise(F.lit(0.0))
    return {"mean_word": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "upper": per("n_upper", "word_chars"), "bangs": per("n_bangs", "n_words"), "stops": per("n_stops", "n_words"), "digits": per("n_digits", "word_chars"), "line_words": per("n_words", "n_lines")}


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def mask(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.threshold if self.above else x[:, self.feature] <= self.threshold


def grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray], max_conditions: int) -> list[Condition]:
    """Add the condition of the highest FOIL gain until only bad rows are covered or nothing gains."""
    rule, inside = [], np.ones(len(x), bool)
    while len(rule) < max_conditions:
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        if n == 0 or p == 0:
            break
        best, pick = 1e-9, None
        for f, at in enumerate(cuts):
            order = np.searchsorted(at, x[inside, f])  # values <= at[j] have order <= j
            pos, neg = (np.bincount(order[bad[inside] == want], minlength=len(at) + 1).cumsum()[:-1] for want in (True, False))
            for above, a, b in ((False, pos, neg), (True, p - pos, n - neg)):
                gain = np.where(a > 0, a * (np.log2(np.maximum(a, 1) / np.maximum(a + b, 1)) - np.log2(p / (p + n))), -1.0)
                if len(gain) and gain.max() > best:
                    best, pick = gain.max(), Condition(f, above, float(at[int(gain.argmax())]))
        if pick is None:
            break
        v = x[inside, pick.feature]
        low, high = v[v <= pick.threshold], v[v > pick.threshold]
        if len(low) and len(high):  # the cut goes midway between the values that it parts
            pick = Condition(pick.feature, pick.above, float(low.max() + high.min()) / 2)
        rule.append(pick)
        inside &= pick.mask(x)
    return rule


def worth(rule: list[Condition], x: np.ndarray, bad: np.ndarray) -> tuple[float, int]:
    """Laplace-corrected precision of a rule and the bad rows it covers."""
    inside = np.ones(len(x), bool)
    for c in rule:
        inside &= c.mask(x)
    p, n = int((bad & inside).sum()), int((~bad & inside).sum())
    return (p + 1) / (p + n + 2), p


@dataclass(frozen=True)
class DecisionList:
    """Ordered (conditions, kept) rules and the verdict where none holds."""

    rules: tuple[tuple[tuple[Condition, ...], bool], ...] = ()
    otherwise: bool = True


def best_rule(x: np.ndarray, wanted: np.ndarray, part: np.ndarray, cuts: list[np.ndarray], max_conditions: int) -> tuple[list[Condition], float, int]:
    """A rule for the wanted rows, grown outside ``part`` and pruned on it; its worth there, and the wanted rows it covers in all."""
    rule = grow(x[~part], wanted[~part], cuts, max_conditions)
    if not rule:
        return rule, 0.0, 0
    rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: worth(r, x[part], wanted[part])[0])
    return rule, worth(rule, x[part], wanted[part])[0], worth(rule, x, wanted)[1]


def learn(x: np.ndarray, bad: np.ndarray, max_rules: int = 16, max_conditions: int = 4, precision: float = 0.85, min_cover: int = 4) -> DecisionList:
    """Sequential covering: grow on two thirds, prune on one, remove what the rule covers, go on.

    In every round one rule is grown for bad and one for good text.  Their
    gain over the share of their class in the rows that are left decides
    between them, so neither class wins by being frequent.
    """
    if not len(x):
        return DecisionList()
    part = np.random.default_rng(7).permutation(len(x)) % 3 == 0
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 129)[1:-1])) for f in range(x.shape[1])]
    rules: list[tuple[tuple[Condition, ...], bool]] = []
    left = np.ones(len(x), bool)
    while len(rules) < max_rules and len(set(bad[left].tolist())) == 2:
        found = []
        for kept in (False, True):
            wanted = bad[left] != kept
            rule, pure, cover = best_rule(x[left], wanted, part[left], cuts, max_conditions)
            prior = float(wanted.mean())
            if rule and cover >= min_cover and pure >= max(precision, (1 + prior) / 2):
                found.append((cover * np.log2(pure / prior), kept, rule))
        if not found:
            break
        _, kept, rule = max(found, key=lambda r: r[0])
        rules.append((tuple(rule), kept))
        inside = left.copy()
        for c in rule:
            inside &= c.mask(x)
        left &= ~inside
    return DecisionList(tuple(rules), worth([], x[left], bad[left])[0] < precision)


def as_column(rules: DecisionList, values: dict[str, Column]) -> Column:
    """The ordered rules as one CASE: the verdict of the first rule that holds."""
    out = None
    for rule, kept in rules.rules:
        test = F.lit(True)
        for c in rule:
            v = values[FEATURES[c.feature]]
            test = test & (v > c.threshold if c.above else v <= c.threshold)
        out = F.when(test, F.lit(kept)) if out is None else out.when(test, F.lit(kept))
    return F.lit(rules.otherwise) if out is None else out.otherwise(F.lit(rules.otherwise))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 6000) -> DecisionList:
    """Rules from a bounded sample of labelled rows (``max_labels``); label 0 is bad.

    Only the statistics of the sample come to the driver, one row an id.
    """
    ids = labelled(labels.select("doc_id", "quality"), "quality", F.lit(True), max_labels)
    s = one_text_each(docs, ids).select("doc_id", "y", text_stats(F.col("text")).alias("s"))
    rows = s.select("doc_id", "y", base_failed(F.col("s")).alias("out"), *[v.alias(k) for k, v in features(F.col("s")).items()]).collect()
    rows = [r for r in rows if not r["out"]]
    rows.sort(key=lambda r: (r["doc_id"], r["y"], *[r[f] for f in FEATURES]))
    x = np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(len(rows), len(FEATURES))
    return learn(x, np.array([r["y"] == 0 for r in rows], bool))


def verdicts(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept for every row of docs."""
    d = docs.select("doc_id", text_stats(F.col("text")).alias("s"))
    s = F.col("s")
    base = [s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return d.select("doc_id", *base, base_failed(s).alias("base_failed"), (~base_failed(s) & as_column(rules, features(s))).alias("kept"))


def keep_good(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """docs without the rejected documents, columns unchanged."""
    return docs.where(let(text_stats(docs["text"]), lambda s: ~base_failed(s) & as_column(rules, features(s))))

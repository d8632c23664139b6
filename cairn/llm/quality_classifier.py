"""A sparse ensemble of conjunctive rules over text statistics.

Shallow trees are boosted on a bounded sample of labelled rows; every path from a
root is a conjunction of comparisons. A lasso-penalised logistic model over those
rules keeps a few with weights, and the model is compiled into one Spark column
expression over the statistics, so scoring stays inside generated code.

Defined cases: a null or empty text has zero counts and is scored like any other;
a document with several labels has the least, a null label is none; with no
labelled rows every score is 0.5, with one class only its smoothed share; rows that
repeat a doc_id are scored each, and so are null ones, which have no label and are not
held out; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.text_stats import NAMES, text_stats
from cairn.session import cut

#: Most labelled rows that the model is fitted on, taken by hash of doc_id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 30, 3, 32, 0.3
PENALTY = 2e-3
STEPS = 400
#: Statistics as SQL over the counts.
FEATURES = {
    "words": "ln(1.0D + n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "bars": "n_bars / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "unique": "n_unique_words / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class RuleModel:
    """bias + the sum of weights of the rules that hold; a rule is ((feature, above, value), ...)."""

    bias: float
    rules: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...]

    def column(self) -> Column:
        """The probability of label 1 as an expression over the feature columns."""
        total = F.lit(self.bias)
        for parts, weight in self.rules:
            holds = F.lit(True)
            for name, above, value in parts:
                holds = holds & ((F.col(name) > F.lit(value)) if above else (F.col(name) <= F.lit(value)))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def _tree(codes: np.ndarray, slope: np.ndarray, bend: np.ndarray, depth: int, least: float) -> list[tuple[tuple, np.ndarray, float]]:
    """Leaves and inner nodes of one tree: (path of (feature, above, bin), rows, step)."""
    out, open_nodes = [], [((), np.arange(len(slope)))]
    while open_nodes:
        path, rows = open_nodes.pop()
        g, h = slope[rows], bend[rows]
        if path:
            out.append((path, rows, float(g.sum() / (h.sum() + 1.0))))
        if len(path) == depth or len(rows) < 2 * least:
            continue
        best = (1e-3, None)
        parent = g.sum() ** 2 / (h.sum() + 1.0)
        for f in range(codes.shape[1]):
            own = codes[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(own, w, BINS)) for w in (g, h, np.ones(len(rows))))
            gain = gs**2 / (hs + 1.0) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1.0) - parent
            gain[(ns < least) | (ns[-1] - ns < least)] = -1.0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), (f, k))
        if best[1]:
            f, k = best[1]
            above = codes[rows, f] > k
            open_nodes += [((*path, (f, True, k)), rows[above]), ((*path, (f, False, k)), rows[~above])]
    return out


def fit(values: np.ndarray, label: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, steps: int = STEPS) -> RuleModel:
    """Boost trees, take their paths as rules, and weigh the rules by lasso."""
    n, share = len(label), (label.sum() + 1.0) / (len(label) + 2.0)
    bias = float(np.log(share / (1 - share)))
    if not n or label.min() == label.max():
        return RuleModel(bias, ())
    edges = [np.unique(np.quantile(values[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(values.shape[1])]
    codes = np.stack([np.searchsorted(e, values[:, f], "left") for f, e in enumerate(edges)], 1)
    score, least = np.full(n, bias), max(5.0, 0.002 * n)
    paths: dict[tuple, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        nodes = _tree(codes, label - p, p * (1 - p), depth, least)
        paths |= {tuple(sorted(path)): None for path, _, _ in nodes}
        ends = {path for path, _, _ in nodes}
        inner = {path[:-1] for path in ends}
        for path, rows, step in nodes:
            if path not in inner:
                score[rows] += RATE * step
    rules = list(paths)
    holds = np.ones((n, len(rules)))
    for j, path in enumerate(rules):
        for f, above, k in path:
            holds[:, j] *= (codes[:, f] > k) == above
    mean = holds.mean(0)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
    x = (holds - mean) / spread
    w, b = np.zeros(len(rules)), bias
    size = 4.0 / (np.linalg.norm(x.T @ x / n, 2) + 1.0)
    look, look_b, t = w.copy(), b, 1.0
    for _ in range(steps):  # accelerated proximal steps
        p = 1 / (1 + np.exp(-(x @ look + look_b)))
        new = look - size * (x.T @ (p - label) / n)
        new = np.sign(new) * np.maximum(np.abs(new) - size * penalty, 0)
        new_b = look_b - size * float((p - label).mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_b = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    kept = [(j, float(w[j] / spread[j])) for j in np.flatnonzero(w)]
    named = lambda path: tuple((names[f], above, float(edges[f][k])) for f, above, k in path)
    return RuleModel(float(b - sum(v * mean[j] for j, v in kept)), tuple((named(rules[j]), v) for j, v in kept))


def statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and FEATURES for every row."""
    stats = text_stats(docs, {"doc_id": F.col(doc_id).cast("long")}, text)
    return stats.select("doc_id", *(F.expr(e).alias(n) for n, e in FEATURES.items()))


def train(features: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on at most sample_rows labelled rows, the least by hash of doc_id."""
    marked = labels.where("quality is not null").groupBy(F.col("doc_id").alias("at")).agg(F.min("quality").alias("quality"))
    rows = features.join(marked, F.col("doc_id") == F.col("at")).select(*FEATURES, "quality", F.xxhash64("doc_id").alias("rank"), "doc_id")
    held = rows.orderBy("rank", "doc_id").limit(sample_rows).select(*FEATURES, "quality").toPandas()
    return fit(held[list(FEATURES)].to_numpy(float), (held["quality"] == 1).to_numpy(float), list(FEATURES))


def score(features: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id, score for every row."""
    return features.select("doc_id", model.column().alias("score"))


def quality_classifier(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32(doc_id) % 5 is 0 are never learned from."""
    fold = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(5))
    features = cut(statistics(docs, text, doc_id), "features")
    model = train(features, labels.where(fold("doc_id") != 0), sample_rows)
    out = score(features, model).withColumn("held_out", F.coalesce(fold("doc_id") == 0, F.lit(False)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Quality rules whose cutoffs carry a guarantee.

Each rule rejects a document whose statistic exceeds a cutoff. Labelled documents
that pass the base rules are the holdout. For every stratum and rule, cutoffs are
tested from the loosest to the tightest: the null hypothesis "more than the rule's
share of good documents is rejected" is tested with the exact binomial tail, and
testing stops at the first cutoff that is not certified (a fixed sequence needs no
correction within it). Across strata and rules the level is divided by their
number, so that with the stated confidence no certified cutoff breaks its limit.
Among certified cutoffs the one that gains most bad documents for the good ones it
costs is used; where none gains, or none is certified, the rule rejects nothing.

Defined cases: a null text has zero counts and fails the base; a null stratum is a
stratum of its own, apart from an empty name; a document with several labels has the
least; a null label is none; a null doc_id has no label; rows that repeat a doc_id are
scored each; without labels the base decides; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.text_stats import NAMES, text_stats
from cairn.session import cut

#: Largest share of good documents that all rules together may reject, and the confidence.
LIMIT, CONFIDENCE = 0.02, 0.95
#: A cutoff must gain so many bad documents for each good one.
WORTH = 20.0
#: Statistic of each rule and its cutoffs from loose to tight; above one, a document is rejected.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.28, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "upper": ("n_upper / greatest(word_chars, 1)", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "word_length": ("word_chars / greatest(n_words, 1)", (40.0, 30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0)),
}
BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), exactly, by the incomplete beta function."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - front * _fraction(b, a, 1.0 - x) / b
    return front * _fraction(a, b, x) / a


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return out


def _step(rule: str) -> Column:
    """How many of a rule's cutoffs the statistic exceeds."""
    stat, cutoffs = RULES[rule]
    return sum((F.expr(stat) > F.lit(c)).cast("int") for c in cutoffs)


def choose(counts: pd.DataFrame, level: float, share: float, worth: float = WORTH) -> dict[str, int]:
    """rule -> number of the chosen cutoff (1 is the loosest) for one stratum.

    counts: rule, step, good, n; good is the label, step the cutoffs exceeded.
    """
    found = {}
    for rule, (_, cutoffs) in RULES.items():
        own = counts[counts.rule == rule]
        total, best, most = int(own[own.good].n.sum()), 0, 0.0
        for k in range(1, len(cutoffs) + 1):
            over = own[own.step >= k]
            lost, gained = int(over[over.good].n.sum()), int(over[~over.good].n.sum())
            if not total or binomial_tail(lost, total, share) > level:
                break
            if gained - worth * lost > most:
                best, most = k, gained - worth * lost
        found[rule] = best
    return found


def cutoffs(stats: DataFrame, labels: DataFrame, limit: float = LIMIT, confidence: float = CONFIDENCE, worth: float = WORTH) -> DataFrame:
    """stratum and, for each rule, the number of its cutoff (0: rejects nothing).

    Only counts by stratum, rule, step and label are gathered.
    """
    marked = labels.where("quality is not null").groupBy(F.col("doc_id").alias("at")).agg(F.min("quality").alias("quality"))
    rows = stats.where("not base_failed").join(marked, F.col("doc_id") == F.col("at"))
    steps = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"step_{r}").alias("step")) for r in RULES))
    rows = rows.select("stratum", (F.col("quality") == 1).alias("good"), F.inline(steps))
    counts = cut(rows.groupBy("stratum", "rule", "step", "good").agg(F.count("*").alias("n")), "counts")
    strata = counts.select("stratum").distinct().count()
    level, share = (1 - confidence) / max(1, strata * len(RULES)), limit / len(RULES)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"stratum": pdf.stratum.iloc[0]} | choose(pdf, level, share, worth)])

    return counts.groupBy("stratum").applyInPandas(pick, "stratum string, " + ", ".join(f"{r} int" for r in RULES))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", doc_id: str = "doc_id", limit: float = LIMIT, confidence: float = CONFIDENCE, worth: float = WORTH) -> DataFrame:
    """Every row with its counts, base_failed, kept and the rule that rejects it, if any."""
    stats = text_stats(docs, {"doc_id": F.col(doc_id).cast("long"), "stratum": F.col(stratum).cast("string")}, text)
    stats = stats.withColumn("base_failed", F.expr(BASE_FAILED)).withColumns({f"step_{r}": _step(r) for r in RULES})
    stats = cut(stats, "stats")
    chosen = cut(cutoffs(stats, labels, limit, confidence, worth), "cutoffs")
    s, c = stats.alias("s"), chosen.alias("c")
    hit = lambda r: (F.col(f"c.{r}") > 0) & (F.col(f"s.step_{r}") >= F.col(f"c.{r}"))
    rejected = F.coalesce(*(F.when(hit(r), F.lit(r)) for r in RULES))
    out = s.join(c, F.col("s.stratum").eqNullSafe(F.col("c.stratum")), "left").select("s.doc_id", *(f"s.{n}" for n in NAMES), "s.base_failed", rejected.alias("rejected_by"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())

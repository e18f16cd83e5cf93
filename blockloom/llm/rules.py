"""Quality rules: an ordered decision list learned from labelled statistics.

Sequential covering: a rule for rejecting is grown on part of the sample by adding the threshold condition with
the best information gain until it covers no good text, then pruned on the rest by dropping last conditions as
long as that does not lower its precision there. What it covers is set aside and the next rule is learned from
what is left, until a rule is no better than chance. The list is emitted as one conditional Spark expression,
first match first, that runs inside the scan's code; only the statistics themselves are computed in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, first_of, labelled, table
from .stats import COLUMNS, statistics

#: Labelled texts that a fit reads at most; those with the smallest id hashes are taken.
MAX_LABELLED = 20_000
#: Thresholds tried for a feature, conditions of a rule, rules of a list, least texts a rule covers.
CUTS, MAX_CONDITIONS, MAX_RULES, MIN_COVER = 32, 4, 12, 4
#: A pruned rule must be right for this share of the pruning part that it covers.
MIN_PRECISION = 0.8
#: Base rules: fewer words, or a larger share (in percent) of words in repeated windows, fail.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


class Condition(NamedTuple):
    """feature >= value, or feature < value."""

    feature: str
    above: bool
    value: float


def ratios() -> dict[str, Column]:
    """The features that rules compare, from the columns of ``statistics``; also right for empty texts."""

    def per(top: str, bottom: str) -> Column:
        return F.col(top) / F.greatest(F.col(bottom), F.lit(1))

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "marks_per_word": per("n_marks", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "distinct_share": per("n_distinct_words", "n_words"),
        "upper_per_lower": per("n_upper", "n_lower"),
        "digits_per_char": per("n_digits", "word_chars"),
        "words_per_line": per("n_words", "n_lines"),
        "longest_word": F.col("longest_word").cast("double"),
    }


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the statistics of the whole text; of clashing names the statistics stay."""
    names = [c for c in keep if c not in COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = statistics(batch.column("text"))[0]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(found[c], pa.int64()) for c in COLUMNS]], [*names, *COLUMNS])

    shape = T.StructType([docs.schema[c] for c in names] + [T.StructField(c, T.LongType()) for c in COLUMNS])
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, shape)


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """FOIL's gain of going from p0 of p0 + n0 to p of p + n."""
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, g, -np.inf)


def _match(rule: list[Condition], x: np.ndarray, names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for c in rule:
        v = x[:, names.index(c.feature)]
        hit &= (v >= c.value) if c.above else (v < c.value)
    return hit


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and bad[inside].any() and not bad[inside].all():
        xs, b = x[inside], bad[inside]
        best = (1e-9, None)
        for j, name in enumerate(names):
            order = np.sort(xs[:, j])
            # Half way between neighbouring values, at quantiles of all and of the bad ones.
            both = np.concatenate([np.quantile(order, np.linspace(0, 1, CUTS)), np.quantile(xs[b, j], np.linspace(0, 1, CUTS))])
            at = np.searchsorted(order, np.unique(both))
            at = at[(at > 0) & (at < len(order))]
            cuts = np.unique((order[at - 1] + order[at]) / 2)
            if not len(cuts):
                continue
            over = xs[:, j][:, None] >= cuts
            p, n = over[b].sum(0), over[~b].sum(0)
            for above, pp, nn in ((True, p, n), (False, b.sum() - p, (~b).sum() - n)):
                g = _gain(pp, nn, b.sum(), (~b).sum())
                g[pp < MIN_COVER] = -np.inf
                if g.max() > best[0]:
                    best = (g.max(), Condition(name, above, float(cuts[g.argmax()])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside = _match(rule, x, names)
    return rule


def _worth(rule: list[Condition], x: np.ndarray, bad: np.ndarray, names: list[str]) -> float:
    hit = _match(rule, x, names)
    p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], seed: int = 3) -> list[list[Condition]]:
    """Ordered rules whose texts are rejected; none where the sample has no bad or no good text."""
    found: list[list[Condition]] = []
    order = np.random.default_rng(seed).permutation(len(x))
    x, bad = x[order], bad[order].astype(bool)
    prune = np.arange(len(x)) % 3 == 0
    while len(found) < MAX_RULES and bad.sum() >= MIN_COVER and not bad.all():
        rule = _grow(x[~prune], bad[~prune], names)
        if not rule:
            break
        worth = _worth(rule, x[prune], bad[prune], names)
        while len(rule) > 1 and _worth(rule[:-1], x[prune], bad[prune], names) >= worth:
            rule = rule[:-1]
            worth = _worth(rule, x[prune], bad[prune], names)
        whole = _match(rule, x, names)
        if worth < 2 * MIN_PRECISION - 1 or bad[whole].mean() < MIN_PRECISION:
            break
        found.append(rule)
        x, bad, prune = x[~whole], bad[~whole], prune[~whole]
    return found


def expression(rules: list[list[Condition]], columns: dict[str, Column]) -> Column:
    """Number of the first rule that fits (from 1), 0 if none does: ordered conditions of one expression."""
    chain = None
    for number, rule in enumerate(rules, 1):
        fits = F.lit(True)
        for c in rule:
            fits = fits & ((columns[c.feature] >= c.value) if c.above else (columns[c.feature] < c.value))
        chain = F.when(fits, F.lit(number)) if chain is None else chain.when(fits, F.lit(number))
    return F.lit(0) if chain is None else chain.otherwise(F.lit(0))


def text_of(rules: list[list[Condition]]) -> list[str]:
    return [" and ".join(f"{c.feature} {'>=' if c.above else '<'} {c.value:.6g}" for c in rule) for rule in rules]


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list[list[Condition]]:
    """Learns from at most ``limit`` labelled texts; a null label counts as none, of several the least.

    The driver gets ``limit`` rows of a few numbers at most, however often a labelled document is repeated. Rows
    that repeat an id with other texts count each; without labels there are no rules.
    """
    columns = ratios()
    both = labelled(docs, labels, limit).withColumnRenamed("quality", "__quality")
    rows = with_statistics(both, ["doc_id", "t", "__quality"]).select("doc_id", "t", "__quality", *[v.alias(k) for k, v in columns.items()])
    rows = first_of(rows, limit).toArrow()
    names = list(columns)
    x = np.stack([rows[n].to_numpy() for n in names], axis=1) if rows.num_rows else np.empty((0, len(names)))
    # Rows in an order that does not depend on the run.
    order = np.lexsort([rows["t"].to_numpy(), rows["doc_id"].to_numpy()]) if rows.num_rows else np.empty(0, np.int64)
    bad = rows["__quality"].to_numpy() == 0 if rows.num_rows else np.empty(0, bool)
    return learn(x[order], bad[order], names)


def apply_rules(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """doc_id and statistics of every text, base_failed, rule (number of the rule that rejects it, else 0), kept.

    Null texts count as empty ones: they have no words and so fail the base rules.
    """
    found = with_statistics(docs, ["doc_id"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = found.withColumn("base_failed", failed).withColumn("rule", expression(rules, ratios()))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op9_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels", False)
    judged = apply_rules(docs, train(docs, labels))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")

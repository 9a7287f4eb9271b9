"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Statistics of whole texts are counted in numpy, batch by batch. Boosted trees of depth 3 are grown
on at most ``MOST_LABELLED`` labelled rows, chosen by the hash of their ids; every path from a
root to a node is a rule, a conjunction of comparisons. A lasso logistic regression weighs rules
and scaled statistics, which leaves most weights at zero, and what is left is compiled into one
Spark column expression that scores every document.

Defined results: null texts have the statistics of empty ones; a null doc_id counts as empty text
in the split and has no label; labels that are null, and ids labelled both ways, are not learnt
from; without any label of both kinds the score is the share of label 1 (0.5 if there is none).
Repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _hashing as H
from ._common import crc_mod

#: The bound of the labelled sample that the rules are fitted on.
MOST_LABELLED = 20_000
STATISTICS = (
    "n_bytes", "n_words", "mean_word", "upper", "digit", "punct", "space", "high", "exclaim", "pipe", "symbol",
    "period", "distinct_words", "top_word", "n_lines", "repeated_lines", "mean_line", "long_words", "upper_words",
)
TREES, DEPTH, BINS, LEARNING = 40, 3, 32, 0.3
LASSO, STEPS = 0.002, 400


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    sets = {name: np.frombuffer(chars, np.uint8) for name, chars in (("exclaim", b"!"), ("pipe", b"|"), ("symbol", b"#$%&*@^~<>{}[]=+_\\"), ("period", b".,;:?"))}
    punct = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
    at = 0
    for lo, hi in H.chunks(texts, 1 << 20):
        w = H.words(texts[lo:hi], H.SPACED)
        sizes = w.end - w.start
        first_byte = np.frombuffer(w.raw, np.uint8)[w.start] if len(w.start) else np.zeros(0, np.uint8)
        last_byte = np.frombuffer(w.raw, np.uint8)[w.end - 1] if len(w.start) else np.zeros(0, np.uint8)
        shouted = (first_byte >= 65) & (first_byte <= 90) & (sizes > 1) & ~((last_byte >= 97) & (last_byte <= 122))
        for t, a, b in zip(texts[lo:hi], w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            t = t or b""
            n, words = max(1, len(t)), max(1, b - a)
            seen = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
            _, times = np.unique(w.hash[a:b], return_counts=True)
            lines = [x for x in t.split(b"\n") if x.strip()]
            r = out[at]
            r[:8] = len(t), b - a, sizes[a:b].sum() / words, seen[65:91].sum() / n, seen[48:58].sum() / n, seen[punct].sum() / n, (seen[32] + seen[9:14].sum()) / n, seen[128:].sum() / n
            r[8:12] = [seen[sets[k]].sum() / n for k in ("exclaim", "pipe", "symbol", "period")]
            r[12:14] = len(times) / words, times.max(initial=0) / words
            r[14:17] = len(lines), 1 - len(set(lines)) / max(1, len(lines)), sum(map(len, lines)) / max(1, len(lines))
            r[17:] = (sizes[a:b] > 15).sum() / words, shouted[a:b].sum() / words
            at += 1
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = statistics(batch.column("text").to_pylist())
        kept = {n: batch.column(n) for n in batch.schema.names if n != "text"}
        yield pa.RecordBatch.from_pydict(kept | {n: pa.array(rows[:, k]) for k, n in enumerate(STATISTICS)})


def measure(docs: DataFrame) -> DataFrame:
    """STATISTICS of column text, in place of it; the other columns stay."""
    docs = docs.withColumn("text", F.col("text").cast("binary"))
    kept = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != "text")
    return docs.mapInArrow(_measure, f"{kept}, " + ", ".join(f"{n} double" for n in STATISTICS))


#: Comparisons (statistic, above, cut) that all hold.
Rule = tuple[tuple[int, bool, float], ...]


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Paths of boosted trees, fitted to the gradient of the logistic loss over binned statistics."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
    margin, rules = np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        nodes: list[tuple[np.ndarray, Rule]] = [(np.arange(len(y)), ())]
        for depth in range(DEPTH):
            below = []
            for rows, path in nodes:
                best = (1e-3, None, 0)
                total_g, total_w = gradient[rows].sum(), weight[rows].sum()
                for k, c in enumerate(cuts):
                    b = binned[rows, k]
                    g = np.cumsum(np.bincount(b, gradient[rows], len(c) + 1))[:-1]
                    w = np.cumsum(np.bincount(b, weight[rows], len(c) + 1))[:-1]
                    n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                    gain = g**2 / (w + 1) + (total_g - g) ** 2 / (total_w - w + 1) - total_g**2 / (total_w + 1)
                    gain[(n < 5) | (len(rows) - n < 5)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), k, int(gain.argmax()))
                if best[1] is None:
                    margin[rows] += LEARNING * total_g / (total_w + 1)
                    continue
                k, cut = best[1], float(cuts[best[1]][best[2]])
                for above in (False, True):
                    side = rows[(binned[rows, k] > best[2]) == above]
                    rule = (*path, (k, above, cut))
                    rules.setdefault(tuple(sorted(set(rule))), None)
                    below.append((side, rule))
            nodes = below
        for rows, _ in nodes:
            margin[rows] += LEARNING * gradient[rows].sum() / (weight[rows].sum() + 1)
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(and_, ((x[:, k] > cut) == above for k, above, cut in rule))


def lasso(a: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept of an l1-penalised logistic regression, by accelerated proximal gradient."""
    n, m = a.shape
    v = np.ones(m) / np.sqrt(max(1, m))
    for _ in range(20):  # the largest singular value bounds the step
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 4 * n / (np.linalg.norm(a @ v) ** 2 + n)
    w, b, w_, b_, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(a @ w_ + b_))) - y
        new, new_b = w_ - rate * (a.T @ r) / n, b_ - rate * r.mean()
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        t_ = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w_, b_ = new + (t - 1) / t_ * (new - w), new_b + (t - 1) / t_ * (new_b - b)
        w, b, t = new, new_b, t_
    return w, b


class Ensemble:
    """Rules and scaled statistics with their weights."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.rules: list[tuple[Rule, float]] = []
        self.linear: list[tuple[int, float, float, float]] = []  # statistic, lowest, highest, weight
        share = float(y.mean()) if len(y) else 0.5
        self.intercept = float(np.log(share / (1 - share))) if 0 < share < 1 else 36.0 * (2 * share - 1)
        if not len(y) or not 0 < share < 1:
            return
        rules = tree_rules(x, y)
        low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
        spread = np.where(high > low, high - low, 1)
        a = np.concatenate([np.stack([holds(r, x) for r in rules], axis=1), (np.clip(x, low, high) - low) / spread] if rules else [(np.clip(x, low, high) - low) / spread], axis=1).astype(np.float32)
        w, b = lasso(a, y)
        self.intercept = float(b)
        self.rules = [(r, float(v)) for r, v in zip(rules, w, strict=False) if v]
        self.linear = [(k, float(low[k]), float(high[k]), float(v)) for k, v in enumerate(w[len(rules) :]) if v]

    def score(self) -> Column:
        """Probability of label 1 as a column expression over STATISTICS."""
        margin = F.lit(self.intercept)
        for rule, weight in self.rules:
            condition = reduce(and_, ((F.col(STATISTICS[k]) > cut) if above else (F.col(STATISTICS[k]) <= cut) for k, above, cut in rule))
            margin = margin + F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
        for k, low, high, weight in self.linear:
            scaled = (F.least(F.greatest(F.col(STATISTICS[k]), F.lit(low)), F.lit(high)) - low) / (high - low or 1.0)
            margin = margin + scaled * weight
        return 1 / (1 + F.exp(-margin))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = MOST_LABELLED, mod: int = 3, held: int = 1) -> Ensemble:
    """Fitted on a row of each of at most ``most`` labelled ids, those of least hash, whose crc32 modulo ``mod`` is not ``held``.

    The ids are sought among the 4 * ``most`` labelled ones of least hash, so that no shuffle of all
    ids is needed to pass over those that documents lack. Of rows that share an id, the one with the
    least statistics is learnt from.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(target).cast("int").alias("label")).dropna()
    ids = ids.filter(F.col("label").isin(0, 1) & (crc_mod("label_id", mod) != held))
    ids = ids.groupBy("label_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other")
    wide = ids.orderBy(F.xxhash64("label_id"), "label_id").limit(4 * most).select("label_id", "label")
    there = docs.select("doc_id").join(F.broadcast(wide), F.col("doc_id") == F.col("label_id")).select("label_id", "label").distinct()
    sample = there.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    rows = measure(docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("doc_id", "label", "text"))
    got = rows.groupBy("doc_id", "label").agg(F.min(F.struct(*STATISTICS)).alias("row")).select("doc_id", "label", "row.*").toArrow().sort_by("doc_id")
    x = np.stack([got[n].to_numpy() for n in STATISTICS], axis=1) if got.num_rows else np.zeros((0, len(STATISTICS)))
    return Ensemble(x, got["label"].to_numpy().astype(np.float64))


def classify(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; rules are learnt where crc32(doc_id) modulo ``mod`` is not ``held``."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", (crc_mod("doc_id", mod) == held).alias("held_out"))
    model = train(docs, labels, mod=mod, held=held)
    scored = measure(docs).select("doc_id", "held_out", model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

"""Language ID: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased, anything ASCII but letters becomes a space, and all n-grams of 1 to 3
characters, with the text's edges as spaces, are hashed into 2**15 buckets. Each task counts the
buckets of its training texts by language, Spark sums the counts, and the log-probability matrix
(languages x buckets) is broadcast. The buckets of a batch of texts are counted sparsely and multiplied
with their rows of the matrix. More than ``GROUP`` languages take a pass for each group of them, whose
results are put together exactly.

A posterior tells which language is likelier, not whether a text is in any: ``accept`` also asks that
the mean log-probability of a text's n-grams lies no further below that of the language's own
n-grams than ``MARGIN`` and ``DEVIATIONS`` standard errors.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text
if no training row has a language. Rows with a null language are not learnt from; a null doc_id
counts as empty text in the split. Repeated rows are learnt from and predicted one by one. Ties go
to the language that sorts first. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, crc_mod, other_columns, restored, sliced

BITS, ORDERS = 15, (1, 2, 3)
#: Languages that a task counts before it sends its counts on.
HELD = 64
#: Languages whose matrix is broadcast at once, about: 128 x 2**15 doubles are 32 MB.
GROUP = 128
#: Languages that a task scores at once.
COLUMNS = 8
#: How far below a language's own mean log-probability of an n-gram a text's may lie: so much, and so many standard errors.
MARGIN, DEVIATIONS = 2.0, 3.0
UNDETERMINED = "und"
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
_ASCII = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)
_EDGE = " " * max(ORDERS)


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the texts' n-grams, a row for each order, and the columns where texts begin."""
    joined = [t.lower() for t in texts]
    sizes = [len(t) + len(_EDGE) for t in joined]
    code = np.frombuffer((_EDGE + _EDGE.join(joined) + _EDGE * 2).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(code < 128, _ASCII[np.minimum(code, 127)], code)
    n = sum(sizes)
    out = np.empty((len(ORDERS), n), np.uint16 if BITS <= 16 else np.uint32)
    for row, order in enumerate(ORDERS):
        h = np.full(n, order, np.uint32)
        for k in range(order):
            h = (h ^ code[k : k + n]) * _MULTIPLIERS[k % 3]
            h ^= h >> np.uint32(15)
        out[row] = (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
    return out, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _pieces(texts: list[str], most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}

    def flush() -> pa.RecordBatch:
        full = {lang: np.flatnonzero(c) for lang, c in held.items()}
        return pa.RecordBatch.from_pydict({
            "lang": pa.array([x for lang, f in full.items() for x in [lang] * (len(f) + 1)], pa.string()),
            "bucket": pa.array(np.concatenate([np.append(f, -1) for f in full.values()]), pa.int32()),
            "n": pa.array(np.concatenate([np.append(held[lang][f], rows[lang]) for lang, f in full.items()]), pa.int64()),
        })

    for batch in sliced(batches):
        by_lang: dict[str, list[str]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            counts = held.setdefault(lang, np.zeros(1 << BITS, np.int64))
            rows[lang] = rows.get(lang, 0) + len(texts)
            for lo, hi in _pieces(texts):
                counts += np.bincount(buckets(texts[lo:hi])[0].ravel(), minlength=1 << BITS)
        if len(held) > HELD:
            yield flush()
            held.clear(), rows.clear()
    if held:
        yield flush()


class Model(NamedTuple):
    """Languages of one group; weights: log-probabilities, buckets x languages; entropy and spread of a language's own n-grams."""

    langs: list[str]
    weights: np.ndarray
    priors: np.ndarray
    entropy: np.ndarray
    spread: np.ndarray


def train(labelled: DataFrame, most: int = GROUP) -> Iterator[Model]:
    """Models of all languages, in groups of about ``most``, one at a time, from text and lang of all rows."""
    rows = labelled.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInArrow(_learn, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).persist()
    try:
        n_langs, n_rows = counts.filter("bucket < 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        groups = -(-n_langs // most)
        for g in range(groups):
            mine = counts.filter(F.pmod(F.xxhash64("lang"), F.lit(groups)) == g)
            got = mine.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("x")).toArrow()
            langs = sorted(got["lang"].to_pylist())
            if not langs:
                continue
            table, priors = np.ones((1 << BITS, len(langs))), np.zeros(len(langs))
            for lang, pairs in zip(got["lang"].to_pylist(), got["x"].to_pylist(), strict=True):
                at, n = np.array([(p["bucket"], p["n"]) for p in pairs], np.int64).T
                k = langs.index(lang)
                priors[k] = n[at < 0].sum()
                table[at[at >= 0], k] += n[at >= 0]
            p = table / table.sum(axis=0)
            weights = np.log(p)
            entropy = -(p * weights).sum(axis=0)
            yield Model(langs, weights, np.log(priors / n_rows), entropy, np.sqrt((p * (weights + entropy) ** 2).sum(axis=0)))
    finally:
        counts.unpersist()


def log_scores(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities, texts x languages, without priors, and the number of n-grams of each text; counts are sparse."""
    grams, first = buckets(texts)
    if len(texts) == 1:  # a long one: its counts are as many as there are buckets
        counts = np.bincount(grams.ravel(), minlength=1 << BITS)
        pairs = np.flatnonzero(counts)
        counts = counts[pairs]
    else:
        text = np.repeat(np.arange(len(texts), dtype=np.uint32), np.diff(first))
        pairs, counts = np.unique((text << np.uint32(BITS)) + grams, return_counts=True)
    begin = np.searchsorted(pairs >> BITS, np.arange(len(texts)))
    bucket, logs = pairs & ((1 << BITS) - 1), np.empty((len(texts), len(model.langs)))
    for k in range(0, len(model.langs), COLUMNS):  # what is multiplied at once does not grow with the languages
        logs[:, k : k + COLUMNS] = np.add.reduceat(counts[:, None] * model.weights[bucket, k : k + COLUMNS], begin, axis=0)
    return logs, np.diff(first) * len(ORDERS)


def _predict(broadcast, carry: bool = False):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            lang, logs, total, fits = (batch.column(c).to_pylist() for c in ("lang_pred", "_log", "_total", "_fits"))
            some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
            for lo, hi in _pieces([texts[i] for i in some]):
                sums, n = log_scores([texts[i] for i in some[lo:hi]], model)
                found = sums + model.priors
                best = found.argmax(axis=1)
                row = np.arange(len(best))
                top = found[row, best]
                mass = np.exp(found - top[:, None]).sum(axis=1)
                least = -model.entropy[best] - MARGIN - DEVIATIONS * model.spread[best] / np.sqrt(n)
                for i, k, x, m, f in zip(some[lo:hi], best.tolist(), top.tolist(), mass.tolist(), (sums[row, best] / n >= least).tolist(), strict=True):
                    if lang[i] is None or (-x, model.langs[k]) < (-logs[i], lang[i]):
                        total[i] = m + (total[i] * math.exp(logs[i] - x) if lang[i] is not None else 0.0)
                        lang[i], logs[i], fits[i] = model.langs[k], x, f
                    else:
                        total[i] += m * math.exp(x - logs[i])
            kept = {n: batch.column(n) for n in batch.schema.names if n not in ("text", "lang_pred", "_log", "_total", "_fits") or (n == "text" and carry)}
            yield pa.RecordBatch.from_pydict(
                kept | {"lang_pred": pa.array(lang, pa.string()), "_log": pa.array(logs, pa.float64()), "_total": pa.array(total, pa.float64()), "_fits": pa.array(fits, pa.bool_())}
            )

    return task


def _told(docs: DataFrame, rows: DataFrame, carry: bool, mod: int, held: int, group: int) -> tuple[DataFrame, bool]:
    """rows with lang_pred, score and fits; and whether there was a language to learn."""
    spark = docs.sparkSession
    learnt = docs.select("doc_id", "text", "lang").filter(crc_mod("doc_id", mod) != held)
    told = rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("lang_pred", "string"), ("_log", "double"), ("_total", "double"), ("_fits", "boolean"))))
    models = train(learnt, group)
    model, work, n = next(models, None), None, 0
    some = model is not None
    while model is not None:
        after = next(models, None)  # whether another group follows
        last = after is None
        names = [c for c in rows.columns if c != "text" or carry or not last] + ["lang_pred", "_log", "_total", "_fits"]
        sent = spark.sparkContext.broadcast(model)
        told = told.mapInArrow(_predict(sent, carry or not last), told.select(*names).schema)
        if work or not last:  # several groups: each reads the texts again, and holds one matrix
            work = work or Workspace(spark)
            told = work.save(told, f"group{n}")
            if n:
                work.drop(f"group{n - 1}")
            sent.destroy()
        model, n = after, n + 1
    score = F.when(F.col("lang_pred").isNull(), 0.0).otherwise(1 / F.col("_total"))
    kept = [c for c in rows.columns if c != "text" or carry]
    return told.select(*kept, F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"), score.alias("score"), F.coalesce("_fits", F.lit(False)).alias("fits")), some


def identify(docs: DataFrame, mod: int = 3, held: int = 1, group: int = GROUP) -> DataFrame:
    """doc_id, held_out, lang_pred and score (posterior) of every row, learnt from rows whose crc32(doc_id) modulo ``mod`` is not ``held``."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", (crc_mod("doc_id", mod) == held).alias("held_out"))
    told, _ = _told(docs, rows, False, mod, held, group)
    return told.select("doc_id", "held_out", "lang_pred", "score")


def accept(docs: DataFrame, least: float = 0.5, mod: int = 3, held: int = 1, group: int = GROUP) -> DataFrame:
    """The rows of docs whose language is told with a score of ``least`` or more and whose n-grams fit it; a missing lang becomes the predicted one.

    Rows without a letter go. If no row has a language to learn from, all rows with a letter stay.
    """
    told, learnt = _told(docs, docs.select("text", other_columns(docs)), True, mod, held, group)
    if learnt:
        told = told.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least) & F.col("fits"))
    else:
        told = told.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return restored(told.withColumn("row", F.col("row").withField("lang", F.coalesce("row.lang", F.nullif(F.col("lang_pred"), F.lit(UNDETERMINED))))), docs)

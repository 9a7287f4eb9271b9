"""Language-model scoring with a weighted backoff automaton of word n-grams.

States are the root, every word that occurs before another token in the training texts, and, for
orders above 2, every context of two words and more that occurs there at least twice. A state has
an arc for each token that followed its context, weighing log10 of the smoothed probability, and a
failure arc to the state of the context less its first word, weighing log10 of the mass left over;
the root has an arc for each token, add-one smoothed. With c() counted in training,

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w | u) = (c(u w) + PRIOR * p(w | u less its first word)) / (c(u) + PRIOR)

so a failure arc of u weighs PRIOR / (c(u) + PRIOR). A text starts at the root, is read once from
left to right and ends with an end token.

Counts cover the whole corpus and the model is never sent anywhere whole: documents are dealt
into blocks, each block sends its distinct n-grams once, packed by ranges of the hash space with
their training counts, Spark sums each range over all blocks, and each block gets back the counts
of just the n-grams it holds. From those it builds its own part of the automaton. Words and pairs
are sent in one round; each higher order takes a round of its own, in which a block sends only
n-grams whose context is a state, as it knows from the round before.

N-grams are told apart by 64-bit hashes: with n distinct ones the odds of any collision are about
n**2 / 2**65.

Defined results: a null text is empty and has one token, the end; a null doc_id counts as empty
text in the split; repeated rows are scored one by one and each counts in training; with no
training texts every state is the root. Other columns are ignored, no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _hashing as H
from ._common import crc_mod, text_or_empty, text_volume

#: Weight of the backoff distribution in a state, in tokens.
PRIOR = 30.0
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 8 << 20
#: Distinct words gathered in a task before they are sent on.
FLUSH = 1 << 20
END = H.mix(np.array([7], np.uint64))[0]

SENT = "n int, bucket int, block long, keys binary, counts binary"
ANSWERS = "n int, bucket int, block long, counts binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, each closed by the end token, and where each text begins."""
    parts, sizes = [], []
    for lo, hi in H.chunks(texts, 1 << 20):
        w = H.words(texts[lo:hi], H.SPACED_LOWER)
        parts.append(np.insert(w.hash, w.first[1:], END))
        sizes.append(np.diff(w.first) + 1)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def least_state(length: int) -> int:
    """How often a context of so many words must occur to be a state."""
    return 1 if length < 2 else 2


class Automaton:
    """The states and arcs over the given tokens; counts are those of training, ``more`` those of orders above 2."""

    def __init__(self, uni: np.ndarray, uni_count: np.ndarray, bi: np.ndarray, bi_count: np.ndarray, total: int, distinct: int, prior: float, *more: np.ndarray) -> None:
        self.uni, self.bi, self.prior = uni, bi, prior
        self.counts = [c.astype(np.float64) for c in (uni_count, bi_count, *more)]
        self.root = (self.counts[0] + 1) / (total + distinct + 1)
        self.known = uni_count > 0
        self.root_weight = np.log10(self.root)

    def traverse(self, word: np.ndarray, arc: np.ndarray, first: np.ndarray, *more: np.ndarray) -> np.ndarray:
        """log10 weight of each step; word, arc, more: places among the n-grams of each order; first: where texts begin, at the root."""
        weight, p = self.root_weight[word].copy(), self.root[word].copy()
        begin = np.zeros(len(word), np.int64)
        begin[first] = first
        before = np.arange(len(word)) - np.maximum.accumulate(begin)
        arcs = (word, arc, *more)
        for n in range(1, len(arcs)):  # from the root up: what a failure arc of a longer context leads to is known
            at = np.flatnonzero(before >= n)
            at = at[arcs[n - 1][at - 1] >= 0]
            context = self.counts[n - 1][arcs[n - 1][at - 1]]
            state = context >= least_state(n)
            at, context = at[state], context[state]
            c = self.counts[n][arcs[n][at]]
            weight[at] = np.where(c > 0, np.log10((c + self.prior * p[at]) / (context + self.prior)), np.log10(self.prior / (context + self.prior)) + weight[at])
            p[at] = (c + self.prior * p[at]) / (context + self.prior)
        return weight


class Ladder:
    """The n-grams of a block, order by order: each order's places and training counts are known before the next is chosen."""

    def __init__(self, texts: list[bytes | None]) -> None:
        self.toks, self.first = tokens(texts)
        self.before = np.arange(len(self.toks)) - np.repeat(self.first[:-1], np.diff(self.first))
        self.hashes = self.toks
        self.keys: list[np.ndarray] = []
        self.arcs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def choose(self) -> np.ndarray:
        """Sets out the distinct n-grams of the next order whose context is a state; returns where they end."""
        n = len(self.keys)
        if n:
            up = np.zeros(len(self.toks), np.uint64)
            up[1:] = H.mix(self.hashes[:-1] * H.BASE + self.toks[1:])
            self.hashes = up
        at = np.flatnonzero(self.before >= n)
        if n > 1:
            context = self.arcs[n - 1][at - 1]
            at = at[(context >= 0) & (self.counts[n - 1][context] >= least_state(n))]
        keys, place = np.unique(self.hashes[at], return_inverse=True)
        arc = np.full(len(self.toks), -1)
        arc[at] = place
        self.keys.append(keys)
        self.arcs.append(arc)
        return at

    def answered(self, answers: pa.Table, buckets: int) -> None:
        """The counts of the order chosen last."""
        n, keys = len(self.keys), self.keys[-1]
        counts, cuts = np.zeros(max(1, len(keys)), np.int64), H.split_by_bucket(keys, buckets)
        mine = answers.filter(pc.equal(answers["n"], n))
        for b, c in zip(mine["bucket"].to_pylist(), mine["counts"].to_pylist(), strict=True):
            counts[cuts[b] : cuts[b + 1]] = H.unpacked_counts(zstandard.decompress(c), cuts[b + 1] - cuts[b])
        self.counts.append(counts)


def _texts(t: pa.Table) -> list[bytes]:
    read = zstandard.ZstdDecompressor().decompress
    return [read(x) for x in t["text"].to_pylist()]


def _sent(ladder: Ladder, orders: list[tuple[int, np.ndarray, np.ndarray]], block: int, buckets: int) -> pa.Table:
    """Rows of SENT; orders: n, the places of its n-grams in training texts, its keys."""
    rows: dict[str, list] = {"n": [], "bucket": [], "keys": [], "counts": []}
    pack = zstandard.ZstdCompressor(level=1).compress
    for n, places, keys in orders:
        counts = np.bincount(places, minlength=len(keys))
        cuts = H.split_by_bucket(keys, buckets)
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            lo, hi = cuts[b], cuts[b + 1]
            for name, x in (("n", n), ("bucket", b), ("keys", pack(H.packed(keys[lo:hi]))), ("counts", pack(H.packed_counts(counts[lo:hi])))):
                rows[name].append(x)
    return pa.table({
        "n": pa.array(rows["n"], pa.int32()),
        "bucket": pa.array(rows["bucket"], pa.int32()),
        "block": pa.array([block] * len(rows["n"]), pa.int64()),
        "keys": pa.array(rows["keys"], pa.binary()),
        "counts": pa.array(rows["counts"], pa.binary()),
    })


def _learn(t: pa.Table, ladder: Ladder) -> np.ndarray:
    return np.repeat(~np.array(t["held_out"].to_pylist(), bool), np.diff(ladder.first))


def send(buckets: int):
    """The words and pairs of a block."""

    def one_block(key: tuple, t: pa.Table) -> pa.Table:
        ladder = Ladder(_texts(t))
        learn = _learn(t, ladder)
        orders = []
        for n in (1, 2):
            at = ladder.choose()
            orders.append((n, ladder.arcs[-1][at[learn[at]]], ladder.keys[-1]))
        return _sent(ladder, orders, key[0].as_py(), buckets)

    return one_block


def send_higher(order: int, buckets: int):
    """The n-grams of an order above 2 whose context is a state, from the counts of all lower orders."""

    def one_block(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        ladder = Ladder(_texts(t))
        for _ in range(1, order):
            ladder.choose()
            ladder.answered(answers, buckets)
        at = ladder.choose()
        learn = _learn(t, ladder)
        return _sent(ladder, [(order, ladder.arcs[-1][at[learn[at]]], ladder.keys[-1])], key[0].as_py(), buckets)

    return one_block


def answer(t: pa.Table) -> pa.Table:
    """One hash range of all blocks: the corpus-wide count of each n-gram that was sent."""
    read, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
    sent = [H.unpacked(read(k)) for k in t["keys"].to_pylist()]
    keys, place = np.unique(np.concatenate(sent), return_inverse=True)
    counts = np.concatenate([H.unpacked_counts(read(c), len(s)) for c, s in zip(t["counts"].to_pylist(), sent, strict=True)])
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, place, counts)
    total = total[place]
    cut = np.split(total, np.cumsum([len(s) for s in sent])[:-1])
    return pa.table({"n": t["n"], "bucket": t["bucket"], "block": t["block"], "counts": pa.array([pack(H.packed_counts(c)) for c in cut], pa.binary())})


def score_block(order: int, buckets: int, total: int, distinct: int, prior: float):
    def one_block(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        ladder = Ladder(_texts(t))
        first = ladder.first
        for _ in range(order):
            ladder.choose()
            ladder.answered(answers, buckets)
        if len(ladder.toks) == 0:
            steps = base = known = np.zeros(0)
        else:
            (word, arc, *more), (uni, bi, *higher) = ladder.arcs, ladder.counts
            model = Automaton(ladder.keys[0], uni, ladder.keys[1], bi, total, distinct, prior, *higher)
            steps, base, known = model.traverse(word, arc, first[:-1], *more), model.root_weight[word], model.known[word]
        add = (lambda x: np.add.reduceat(x, first[:-1])) if len(ladder.toks) else (lambda x: x)
        return pa.table({
            "doc_id": t["doc_id"],
            "held_out": t["held_out"],
            "n_tokens": pa.array(np.diff(first), pa.int64()),
            "n_known": pa.array(add(known.astype(np.int64)), pa.int64()),
            "base_score": pa.array(add(base), pa.float64()),
            "score": pa.array(add(steps), pa.float64()),
        })

    return one_block


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = pa.array([pack(x) for x in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([texts if n == "text" else batch.column(n) for n in batch.schema.names], batch.schema.names)


def _vocabulary(buckets: int):
    """Distinct training words of a task by hash range, and its number of tokens."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            keys = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            cuts = H.split_by_bucket(keys, buckets)
            full = [0, *(np.flatnonzero(np.diff(cuts[1:])) + 1).tolist()]
            return pa.RecordBatch.from_pydict({
                "bucket": pa.array(full, pa.int32()),
                "keys": pa.array([H.packed(keys[cuts[b] : cuts[b + 1]]) for b in full], pa.binary()),
                "tokens": pa.array([n, *[0] * (len(full) - 1)], pa.int64()),
            })

        for batch in batches:
            toks, _ = tokens(batch.column("text").to_pylist())
            n += len(toks)
            held.append(np.unique(toks))
            if sum(map(len, held)) > FLUSH:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return task


def _count_distinct(t: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate([H.unpacked(k) for k in t["keys"].to_pylist()]))
    return pa.table({"distinct": pa.array([len(keys)], pa.int64()), "tokens": pa.array([sum(t["tokens"].to_pylist())], pa.int64())})


def totals(train: DataFrame, volume: int, range_bytes: int = RANGE_BYTES) -> tuple[int, int]:
    """N and V: tokens and distinct tokens of the training texts."""
    buckets = max(1, -(-volume // 4 // range_bytes))
    sent = train.select("text").mapInArrow(_vocabulary(buckets), "bucket int, keys binary, tokens long")
    row = sent.groupBy("bucket").applyInArrow(_count_distinct, "distinct long, tokens long").agg(F.sum("tokens"), F.sum("distinct")).first()
    return int(row[0] or 0), int(row[1] or 0)


def score(
    docs: DataFrame, mod: int = 7, held: int = 2, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES, order: int = 2
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every row.

    Training texts are those whose crc32(doc_id) modulo ``mod`` is not ``held``; ``order`` is 2 or more.
    """
    docs = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("text"), (crc_mod("doc_id", mod) == held).alias("held_out"))
    _, volume = text_volume(docs)
    blocks, buckets = max(1, -(-volume // block_bytes)), max(1, -(-volume * 4 // 3 // range_bytes))
    n, v = totals(docs.filter(~F.col("held_out")), volume, range_bytes)
    # A row's block follows from the row, so that a task that runs again deals alike; texts travel compressed.
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    dealt = dealt.mapInArrow(_compressed, dealt.schema).repartition(blocks, "block")
    answers = dealt.groupBy("block").applyInArrow(send(buckets), SENT).groupBy("n", "bucket").applyInArrow(answer, ANSWERS)
    for k in range(3, order + 1):
        sent = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(send_higher(k, buckets), SENT)
        answers = answers.unionByName(sent.groupBy("n", "bucket").applyInArrow(answer, ANSWERS))
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score_block(order, buckets, n, v, prior), RESULT)
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))

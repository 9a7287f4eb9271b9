"""Best-fit packing of tokenised documents into sequences by exact-complement hashing.

A document is its token ids and one closing id; longer ones are cut into pieces of the capacity,
the first piece being the shorter one. How many pieces there are of each length is all that
matters for packing, so at most ``capacity`` counts reach the driver. There, the largest length
left is taken and the gap beside it is filled exactly by one length, a pair or a triple that an
index of the lengths left lists under that sum, each as many times as the counts allow; what has no
exact filling is completed by best fit, the longest length that fits first. The plan says, for ranges of ranks within a length, to
which sequences and offsets they go; it has a few slots for each length, whatever the number of
documents, and joins back to the pieces by rank.

Ranks need no global sort: a task numbers its pieces of each length as it tokenises, and the
counts by task and length, summed up, give each task its first rank.

Defined results: a null text is empty and gives one piece that holds the closing id; repeated rows
are packed one by one; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bpe import Encoder
from ._common import Workspace, sliced, text_or_empty

PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, pos long"
#: Most rows of first ranks that are broadcast, of 24 bytes each.
MOST_RANKS = 1 << 19
PLAN = "length long, low long, high long, first_sequence long, offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and end of the pieces of n ids."""
    head = n - capacity * (-(-n // capacity) - 1)
    return [(0, head), *((a, a + capacity) for a in range(head, n, capacity))]


def _tokenise(path: str, closing: int, capacity: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.at(path), TaskContext.get().partitionId()
        end, seen = closing.to_bytes(4, "little"), defaultdict(int)
        for batch in sliced(batches):
            doc_ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 1024):
                out: dict[str, list] = {k.split()[0]: [] for k in PIECES.split(", ")}
                for doc_id, ids in zip(doc_ids[at : at + 1024], encoder.encode(texts[at : at + 1024]), strict=True):
                    ids += end
                    for k, (a, b) in enumerate(cut(len(ids) // 4, capacity)):
                        for name, x in (("doc_id", doc_id), ("piece", k), ("start", a), ("length", b - a), ("ids", ids[4 * a : 4 * b]), ("part", part), ("pos", seen[b - a])):
                            out[name].append(x)
                        seen[b - a] += 1
                yield pa.RecordBatch.from_pydict({
                    name: pa.array(v, pa.binary() if name == "ids" else pa.int32() if name in ("piece", "part") else pa.int64()) for name, v in out.items()
                })

    return task


class SumIndex:
    """Lengths left, and the singles, pairs and triples of them by their sum."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = np.zeros(capacity + 1, np.int64)
        self.left[list(counts)] = list(counts.values())

    def times(self, combos: np.ndarray) -> np.ndarray:
        """How often each combination (a row of lengths, repeats side by side) can be taken."""
        same = (combos[:, :, None] == combos[:, None, :]).sum(axis=2)
        return (self.left[combos] // same).min(axis=1, initial=np.iinfo(np.int64).max)

    def fillings(self, gap: int) -> Iterator[np.ndarray]:
        """Combinations of that sum: the single, then pairs, then triples, each with the longest length first."""
        yield np.array([[gap]])
        a = np.flatnonzero(self.left[:gap])[::-1]
        b = gap - a
        yield np.stack((a, b), axis=1)[(a >= b) & (self.left[b] > 0)]
        a, b = a[a >= -(-gap // 3)], np.flatnonzero(self.left[:gap])[::-1]
        x, y = np.repeat(a, len(b)), np.tile(b, len(a))
        z = gap - x - y
        good = (x >= y) & (y >= z) & (z > 0)
        x, y, z = x[good], y[good], z[good]
        yield np.stack((x, y, z), axis=1)[self.left[z] > 0]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows of PLAN: pieces of a length with ranks low to high - 1 go, one each, to sequences from first_sequence on, at offset.

    Counts only fall, so a combination that was used up is never looked at again: each gap's
    combinations are gone through once.
    """
    index = SumIndex({n: c for n, c in counts.items() if c > 0}, capacity)
    left = index.left
    used: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(lengths: list[int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for n in lengths:
            rows.append((n, used[n], used[n] + times, sequences, offset))
            used[n] += times
            left[n] -= times
            offset += n
        sequences += times

    while left.any():
        first = int(np.flatnonzero(left)[-1])
        gap = capacity - first
        if gap == 0:
            place([first], int(left[first]))
            continue
        for combos in index.fillings(gap):
            combos = np.concatenate((np.full((len(combos), 1), first), combos), axis=1)
            while len(combos := combos[index.times(combos) > 0]):
                place(combos[0].tolist(), int(index.times(combos[:1])[0]))
        while left[first]:
            lengths, rest = [first], gap
            left[first] -= 1  # set aside while the others are chosen
            taken = left.copy()
            while rest and len(fit := np.flatnonzero(taken[: rest + 1])):
                lengths.append(int(fit[-1]))
                taken[lengths[-1]] -= 1
                rest -= lengths[-1]
            left[first] += 1
            place(lengths, int(index.times(np.array([lengths]))[0]))
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, closing: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset; a row for each piece."""
    spark = docs.sparkSession
    work = Workspace(spark)
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("string").alias("text"))
    pieces = work.save(texts.mapInArrow(_tokenise(tokenizer, closing, capacity), PIECES), "pieces")
    by_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counted = by_task.groupBy("length").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("tasks")).collect()
    slots = spark.createDataFrame(plan({r["length"]: r["n"] for r in counted}, capacity), PLAN)  # bounded by the number of lengths
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # A row for each length of each task. Where they are too many to broadcast, pieces are shuffled to
    # them; a key then holds what one task made of one length, no more than the split that it read.
    if sum(r["tasks"] for r in counted) <= MOST_RANKS:
        ranks = F.broadcast(ranks)
    ranked = pieces.join(ranks, ["part", "length"]).withColumn("rank", F.col("pos") + F.col("base"))
    s, p = F.broadcast(slots).alias("s"), ranked.alias("p")
    here = (F.col("p.length") == F.col("s.length")) & (F.col("p.rank") >= F.col("s.low")) & (F.col("p.rank") < F.col("s.high"))
    return p.join(s, here).select("doc_id", "piece", "start", "p.length", "ids", (F.col("first_sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")

"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``width`` consecutive words of the items; an item of fewer words, but
not none, is one pattern. Patterns of one length share a shift table: it tells, by the hash of
the last two words read, how many words can be skipped because no pattern has that pair nearer to
its end. Where the shift is zero, the pair's hash selects a bucket of patterns, and their words
are compared one by one with the document's.

The tables are made on the driver and broadcast, for parts of up to ``part_bytes`` of item text, as
arrays that a worker reads once; a larger benchmark takes several passes, each over whole documents
and adding to the hits of the pass before.

Defined results: null or empty texts have no words and no hits; null or empty items have no
pattern; an item with a null id covers words but has no name to list, repeated items count once by
id; repeated rows are judged one by one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _hashing as H
from ._common import Workspace, other_columns, restored, sliced, text_volume

PART_BYTES = 4 << 20
FOUND = "{row}, text binary, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _blocks(hashes: np.ndarray, block: int) -> np.ndarray:
    """Hash of the block that ends at each word (along the last axis)."""
    if block == 1:
        return hashes
    out = hashes.copy()
    out[..., 1:] = H.mix(hashes[..., :-1] * H.BASE + hashes[..., 1:])
    return out


class ShiftTable:
    """Patterns of one length: which positions to skip, and which patterns to compare at the others.

    Made once, on the driver, of arrays only. Pattern k, in the order of its last block's hash, is
    ``text[start[k]:end[k]]``, words with one space between; its items are those from owner_first[k] on.
    """

    def __init__(self, hashes: np.ndarray, text: bytes, start: np.ndarray, end: np.ndarray, owners: list[list[int]]) -> None:
        self.words = hashes.shape[1]
        self.block = min(2, self.words)
        most = self.words - self.block + 1
        blocks = _blocks(hashes, self.block)[:, self.block - 1 :]
        self.bits = max(12, int(blocks.size * 4).bit_length())
        self.shift = np.full(1 << self.bits, min(most, 255), np.uint8)
        for j in range(blocks.shape[1]):  # blocks nearer to the end come later and allow less
            self.shift[blocks[:, j] >> np.uint64(64 - self.bits)] = min(most - 1 - j, 255)
        order = np.argsort(blocks[:, -1], kind="stable")
        self.last, self.text, self.start, self.end = blocks[order, -1], text, start[order], end[order]
        sorted_owners = [owners[k] for k in order.tolist()]
        self.owner_first = np.concatenate(([0], np.cumsum([len(x) for x in sorted_owners])))
        self.owners = np.array([k for x in sorted_owners for k in x], np.int64)

    def search(self, w: H.Words) -> Iterator[tuple[int, int, int, list[int]]]:
        """Text, first word, end and items of each occurrence."""
        blocks = _blocks(w.hash, self.block)
        shift = self.shift[blocks >> np.uint64(64 - self.bits)]
        zero = np.flatnonzero(shift == 0)
        low, high = np.searchsorted(self.last, blocks[zero]), np.searchsorted(self.last, blocks[zero], "right")
        shift[zero[low == high]] = 1  # no bucket of that hash
        found = low < high
        buckets = dict(zip(zero[found].tolist(), zip(low[found].tolist(), high[found].tolist(), strict=True), strict=True))
        shift = shift.tobytes()
        bounds = w.first.tolist()
        for d, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            i = lo + self.words - 1
            while i < hi:
                if skip := shift[i]:
                    i += skip
                    continue
                a = i - self.words + 1
                here = b" ".join(w.raw[x:y] for x, y in zip(w.start[a : i + 1].tolist(), w.end[a : i + 1].tolist(), strict=True))
                for k in range(*buckets[i]):
                    if here == self.text[self.start[k] : self.end[k]]:
                        yield d, a - lo, i + 1 - lo, self.owners[self.owner_first[k] : self.owner_first[k + 1]].tolist()
                i += 1


def shift_tables(items: list[bytes | None], width: int) -> list[ShiftTable]:
    w = H.words(items, H.ALNUM)
    text = b" ".join(w.raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True))
    sizes = w.end - w.start
    begin = np.cumsum(sizes + 1) - sizes - 1
    end = begin + sizes
    n_words = np.diff(w.first)
    length = np.minimum(n_words, width)
    made = []
    for n in np.unique(length[length > 0]).tolist():
        mine = np.flatnonzero(length == n)
        count = n_words[mine] - n + 1
        owner = np.repeat(mine, count)
        at = np.arange(count.sum()) + np.repeat(w.first[:-1][mine] - np.cumsum(count) + count, count)
        places: dict[bytes, int] = {}
        owners: list[list[int]] = []
        first: list[int] = []
        for k, i, x, y in zip(owner.tolist(), at.tolist(), begin[at].tolist(), end[at + n - 1].tolist(), strict=True):
            p = places.setdefault(text[x:y], len(owners))
            if p == len(owners):
                owners.append([k])
                first.append(i)
            elif owners[p][-1] != k:
                owners[p].append(k)
        i = np.array(first)
        made.append(ShiftTable(w.hash[i[:, None] + np.arange(n)], text, begin[i], end[i + n - 1], owners))
    return made


def _merge(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(b, out[-1]["end"])
        else:
            out.append({"start": a, "end": b})
    return out


def _search(patterns):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tables = patterns.value
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            spans = [[(s["start"], s["end"]) for s in x or ()] for x in batch.column("spans").to_pylist()]
            items = [set(x or ()) for x in batch.column("items").to_pylist()]
            n_words: list[int] = []
            for lo, hi in H.chunks(texts, 1 << 20):
                w = H.words(texts[lo:hi], H.ALNUM)
                n_words += np.diff(w.first).tolist()
                for table in tables:
                    for d, a, b, found in table.search(w):
                        if spans[lo + d] and spans[lo + d][-1][1] >= a >= spans[lo + d][-1][0]:
                            spans[lo + d][-1] = (spans[lo + d][-1][0], max(b, spans[lo + d][-1][1]))
                        else:
                            spans[lo + d].append((a, b))
                        items[lo + d].update(ids[k] for k in found if ids[k] is not None)
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"),
                "text": batch.column("text"),
                "n_words": pa.array(n_words, pa.int64()),
                "spans": pa.array([_merge(x) for x in spans], _SPANS),
                "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            })

    return task


def find(docs: DataFrame, benchmark: DataFrame, width: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """row (the columns but text), text, n_words, spans (merged word intervals hit) and items (ids as text, sorted) of every row."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).filter("text IS NOT NULL")
    _, volume = text_volume(items)
    parts = max(1, -(-volume // part_bytes))
    found = docs.select(
        other_columns(docs),
        F.col("text").cast("binary").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    schema = FOUND.format(row=f"row {found.schema['row'].dataType.simpleString()}")
    work = Workspace(spark) if parts > 1 else None
    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        patterns = spark.sparkContext.broadcast(([r["item_id"] for r in rows], shift_tables([bytes(r["text"]) for r in rows], width)))
        found = found.mapInArrow(_search(patterns), schema)
        if work:
            found = work.save(found, f"part{k}")
            if k:
                work.drop(f"part{k - 1}")
            patterns.destroy()
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit (words hit), n_items, items, spans and contaminated of every row."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = find(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, width, part_bytes)
    return found.select(
        "row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (n_hit > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of docs in which no window occurs."""
    return restored(find(docs, benchmark, width, part_bytes).filter(F.size("spans") == 0), docs)

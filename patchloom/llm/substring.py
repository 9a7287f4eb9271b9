"""Substring dedup: repeated fixed-length token windows become maximal removal intervals.

Every window of ``width`` words gets a Rabin-Karp hash that rolls over the text. Documents are
cut into blocks of about equal bytes by ranges of (doc_id, hash of the text), so that a frequent or
missing doc_id fills as many blocks as it needs; copies of one row may go to several. A block sends each of its distinct window hashes once, as
sorted 8-byte keys packed by ranges of the hash space; Spark brings one hash range of all blocks
together, where the lowest block that holds a hash is found, and the answer, one bit for each key
sent, goes back to the block. A window is repeated if an earlier block has it or if it started
earlier in its own block. A common window thus costs one key per block, however often it occurs.

Windows are equal if their 64-bit hashes are; with n distinct windows the odds that any two
collide are about n**2 / 2**65.

Defined results: a null text has no words; texts under ``width`` words have no window; rows that
share a doc_id count as separate documents ordered by a hash of the text, so a repeated row loses
its windows;
null ids come first. Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _hashing as H
from ._common import text_volume

#: Text of one block, and keys of one hash range, in bytes.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 8 << 20
#: Sampled points for each block, from which cuts are taken, and most of them in all.
POINTS, MOST_POINTS = 64, 1 << 18
#: Bytes that a row counts for besides its text.
ROW_BYTES = 16

SENT = "bucket int, block long, keys binary"
ANSWERS = "block long, bucket int, bits binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,end:long>>"


def _cuts(docs: DataFrame, n: int) -> list[tuple[bool, int, int]]:
    """Sorted keys (has an id, doc_id or 0, hash) that cut docs into n blocks of about equal bytes; a heavy key comes more than once."""
    rows, volume = text_volume(docs)
    points = min(POINTS * n, MOST_POINTS)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES  # times the points it is beyond an int
    taken = F.floor(size * points / max(1, volume + ROW_BYTES * rows) + F.rand(17))
    key = (F.col("doc_id").isNotNull().alias("some"), F.coalesce("doc_id", F.lit(0)).alias("id"), "hash")
    got = docs.select(*key, taken.alias("n")).filter("n > 0").toArrow()
    some, ids, hashes = (got[c].to_numpy() for c in ("some", "id", "hash"))
    order = np.lexsort((hashes, ids, some))
    reach = np.cumsum(got["n"].to_numpy()[order])
    if not len(reach):
        return []
    at = order[np.searchsorted(reach, np.arange(1, n) * (reach[-1] / n), "right").clip(max=len(order) - 1)]
    return list(zip(some[at].tolist(), ids[at].tolist(), hashes[at].tolist(), strict=True))


def range_blocks(docs: DataFrame, n: int) -> Column:
    """A block number below n for each row of docs (doc_id, hash, text) that never falls as (doc_id, hash) rises; null ids are first."""
    cuts = _cuts(docs, n)
    if not cuts:
        return F.lit(0).cast("long")
    keys = sorted(set(cuts))
    times = Counter(cuts)
    listed = lambda x, kind: F.expr(f"array({','.join(map(str, x))})").cast(f"array<{kind}>")
    ids, hashes = listed([f"{k[1]}L" for k in keys], "long"), listed([f"{k[2]}L" for k in keys], "long")
    upto = listed(np.cumsum([0] + [times[k] for k in keys]).tolist(), "long")
    no_id = sum(not k[0] for k in keys)
    none = F.col("doc_id").isNull()
    first = F.when(none, 0).otherwise(no_id)
    most = F.when(none, no_id).otherwise(len(keys) - no_id)
    own = F.coalesce("doc_id", F.lit(0))

    def further(at: Column, step: Column) -> Column:
        i = first + at + step - 1
        reached = (F.get(ids, i) < own) | ((F.get(ids, i) == own) & (F.get(hashes, i) <= F.col("hash")))
        return F.when((at + step <= most) & reached, at + step).otherwise(at)

    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(keys).bit_length()))))
    passed = F.aggregate(steps, F.lit(0), further)
    block = F.get(upto, first + passed)
    if max(times.values()) == 1:
        return block
    # Rows of a key that is cut at more than once are equal, so any of its blocks will do.
    last = first + passed - 1
    same = (passed > 0) & (F.get(ids, last) == own) & (F.get(hashes, last) == F.col("hash"))
    spread = F.floor(F.rand(18) * F.get(listed([times[k] for k in keys], "long"), last))
    return block - F.when(same, spread).otherwise(F.lit(0))


def _ordered(t: pa.Table) -> tuple[list, list[bytes | None]]:
    ids, texts, hashes = t["doc_id"].to_pylist(), t["text"].to_pylist(), t["hash"].to_pylist()
    texts = [x.encode() if isinstance(x, str) else x for x in texts]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, hashes[i], texts[i] or b""))
    return [ids[i] for i in order], [texts[i] for i in order]


def _distinct(texts: list[bytes | None], width: int) -> tuple[list[H.Words], np.ndarray, np.ndarray, np.ndarray]:
    """Words by chunk; the sorted distinct window hashes; for each window its place among them and whether it is the first."""
    parts, hashes = [], []
    for lo, hi in H.chunks(texts, 1 << 20):
        parts.append(H.words(texts[lo:hi], H.SPACED))
        hashes.append(H.text_windows(parts[-1], width)[0])
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    keys, at, place = np.unique(every, return_index=True, return_inverse=True)
    first = np.zeros(len(every), bool)
    first[at] = True
    return parts, keys, place, first


def send(width: int, buckets: int):
    def one_block(key: tuple, t: pa.Table) -> pa.Table:
        _, texts = _ordered(t)
        _, keys, _, _ = _distinct(texts, width)
        cuts = H.split_by_bucket(keys, buckets)
        full = np.flatnonzero(np.diff(cuts))
        return pa.table({
            "bucket": pa.array(full, pa.int32()),
            "block": pa.array([key[0].as_py()] * len(full), pa.int64()),
            "keys": pa.array([keys[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
        })

    return one_block


def answer(t: pa.Table) -> pa.Table:
    """One hash range of all blocks: for each key sent, whether a lower block has it too."""
    t = t.sort_by("block")
    sent = [np.frombuffer(k, np.uint64) for k in t["keys"].to_pylist()]
    every = np.concatenate(sent) if sent else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")  # blocks ascend in ``every``
    again = np.zeros(len(every), bool)
    again[order[1:]] = every[order[1:]] == every[order[:-1]]
    ends = np.cumsum([len(s) for s in sent])
    bits = [np.packbits(x).tobytes() for x in np.split(again, ends[:-1])] if sent else []
    return pa.table({"block": t["block"], "bucket": t["bucket"], "bits": pa.array(bits, pa.binary())})


def remove(width: int, buckets: int):
    def one_block(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = _ordered(t)
        parts, keys, place, first = _distinct(texts, width)
        cuts = H.split_by_bucket(keys, buckets)
        earlier = np.zeros(len(keys), bool)
        for b, bits in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True):
            lo, hi = cuts[b], cuts[b + 1]
            earlier[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
        repeated = earlier[place] | ~first if len(place) else np.zeros(0, bool)
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_text": [], "spans": []}
        at = 0
        for w in parts:
            starts = H.window_starts(w.first, width)
            cover = np.zeros(len(w.start) + 1, np.int32)
            hit = starts[repeated[at : at + len(starts)]]
            at += len(starts)
            cover[hit] += 1
            np.add.at(cover, hit + width, -1)
            gone = np.cumsum(cover[:-1]) > 0
            for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                g = gone[lo:hi]
                edges = np.flatnonzero(np.diff(np.concatenate(([0], g.astype(np.int8), [0]))))
                keep = np.flatnonzero(~g) + lo
                out["n_words"].append(hi - lo)
                out["n_removed"].append(int(g.sum()))
                out["kept_text"].append(b" ".join([w.raw[a:b] for a, b in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)]).decode("utf-8", "replace"))
                out["spans"].append([{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()),
            "n_words": pa.array(out["n_words"], pa.int64()),
            "n_removed": pa.array(out["n_removed"], pa.int64()),
            "kept_text": pa.array(out["kept_text"], pa.string()),
            "spans": pa.array(out["spans"], span),
        })

    return one_block


def deduplicate(docs: DataFrame, width: int = 20, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space), spans (word intervals removed)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).withColumn("hash", F.xxhash64("text"))
    _, volume = text_volume(docs)
    blocks = max(1, -(-volume // block_bytes))
    buckets = max(1, -(-volume * 4 // 3 // range_bytes))  # about a key for six bytes of text
    dealt = docs.withColumn("block", range_blocks(docs, blocks)).repartition(blocks, "block")
    answers = dealt.groupBy("block").applyInArrow(send(width, buckets), SENT).groupBy("bucket").applyInArrow(answer, ANSWERS)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove(width, buckets), RESULT)


__all__ = ["deduplicate"]

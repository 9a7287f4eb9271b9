"""N-gram Jaccard join by chosen paths.

Sets are the distinct shingles (runs of ``shingle`` words) of the texts; equal sets collapse to
one node first, so copies never meet. In each run a node chooses the shingle that a hash shared by
all nodes puts first, and nodes that chose the same one share a bucket: two nodes do so with a
probability equal to their similarity. Small buckets are brute-forced over sketches. A large
bucket is split again on further chosen shingles, ``BRANCHES`` of them at each level. Runs repeat
until a pair at the threshold is missed with a probability below 1 - recall (11 runs for 0.8 and
1 - 4e-8; a recall that sketches cannot give is an error); splitting adds a little, far below the loss of one run.

What comes out of buckets is not pairs but, for each bucket, a star of each set of nodes that
sketches connect, so rows stay linear in the bucket. A large bucket whose nodes all agree with its
first one is not split but becomes one star, and so does one that splitting cannot make small. The
candidate components that the stars make up are then compared exactly, each pair of shingle sets
in one place: a component lies in one task or, if its sets or their shingles are many, in one task
for each pair of its parts. The task compares strips of rows, so that its memory does not grow with
the square of the sets, counts links and returns stars of the true links, whose components are the
classes. No pair is capped, dropped or sent anywhere.

Sets are compared by 64-bit shingle hashes, nodes told apart by 128-bit digests of them.

Defined results: words are runs of digits, letters and non-ASCII signs, A-Z lower-cased; a text of
fewer words than a shingle, but not none, is one shingle; a text without words (or null) is in a
class of its own, with no link. class_id is the smallest doc_id of the class (null if it has
none), n_links counts the other texts (not their copies) that are similar, n_copies the documents
with an equal set, this one included. Repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _hashing as H
from ._common import Workspace, sliced
from .components import components

SKETCH, BRANCHES, SMALL, DEPTH = 64, 3, 4096, 4
#: Of SKETCH agreements that a candidate needs: far below what a similarity of 0.8 gives (51, deviation 3.2).
AGREE = 0.5
#: Shingle hashes, and nodes, of one part of a component.
PART, PART_NODES = 1 << 20, 4096
#: Cells of any matrix that a comparison holds.
CELLS = 1 << 21
_TURN = (np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, SKETCH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

#: Of pairs at the threshold: 11 runs lose 2.1e-8 of them, the sketch test 1.8e-8.
RECALL = 1 - 4e-8
#: A text that has a word.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

SETS = "doc_id long, row_key long, node binary, size int, sketch binary, chosen array<long>"
VERIFIED = "node binary, root binary, n_links long"


def shingle_sets(texts: list[bytes | None], shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for lo, hi in H.chunks(texts, 1 << 20):
        w = H.words(texts[lo:hi], H.ALNUM)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            yield np.unique(H.windows(w.hash[a:b], min(shingle, b - a))) if b > a else np.zeros(0, np.uint64)


def _turned(s: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The low byte of the first shingle under each of SKETCH hashes, and the whole hashes."""
    first = np.full(SKETCH, np.uint64(2**64 - 1))
    for a in range(0, len(s), 4096):
        x = s[a : a + 4096, None] * _TURN
        x ^= x >> np.uint64(32)
        np.minimum(first, x.min(axis=0), out=first)
    return ((first * H.BASE) >> np.uint64(56)).astype(np.uint8).tobytes(), first


def _sets(shingle: int, runs: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            node, size, sketch, chosen = [], [], [], []
            for s in shingle_sets(texts, shingle):
                low, first = _turned(s)
                node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                size.append(len(s))
                sketch.append(low)
                chosen.append(first[:runs].astype(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "row_key": batch.column("row_key"),
                "node": pa.array(node, pa.binary()),
                "size": pa.array(size, pa.int32()),
                "sketch": pa.array(sketch, pa.binary()),
                "chosen": pa.array(chosen, pa.list_(pa.int64())),
            })

    return task


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Tables of about ``most`` rows from sorted batches, never parting rows of one key."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in sliced(batches):
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        t = pa.Table.from_batches(held)
        keys = t[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
        held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _group_edges(keys: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes is connected with by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if np.array_equal(after, root):
            return root
        root = after


def _near(sketch: np.ndarray, need: int) -> np.ndarray:
    """For each row of one bucket the smallest row that sketches connect it with.

    A row is compared with those not connected with it yet, so a bucket of copies costs its size.
    """
    n = len(sketch)
    root = np.arange(n)
    for i in range(n - 1):
        apart = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if len(apart):
            met = apart[(sketch[apart] == sketch[i]).sum(axis=1) >= need]
            if len(met):
                joined = np.append(root[met], root[i])
                root[np.isin(root, joined)] = joined.min()
    return root


def _brute_force(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the nodes that sketches connect, from buckets sorted by path and node."""
    need = round(AGREE * SKETCH)
    for t in _whole_groups(batches, "path", 4096):
        nodes = t["node"].to_pylist()
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        edges = _group_edges(t["path"].to_numpy())
        sizes = np.diff(edges)
        root = np.arange(len(nodes))
        pairs = edges[:-1][sizes == 2]  # most buckets
        met = pairs[(sketch[pairs] == sketch[pairs + 1]).sum(axis=1) >= need]
        root[met + 1] = met
        for lo, n in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            root[lo : lo + n] = _near(sketch[lo : lo + n], need) + lo
        far = np.flatnonzero(root != np.arange(len(nodes))).tolist()
        yield pa.RecordBatch.from_pydict({"a": pa.array([nodes[i] for i in far], pa.binary()), "b": pa.array([nodes[root[i]] for i in far], pa.binary())})


def _agreement(a: Column, b: Column) -> Column:
    same = lambda n, i: n + (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.lit(SKETCH)), F.lit(0), same)


def candidates(nodes: DataFrame, work: Workspace, small: int = SMALL, depths: int = DEPTH) -> DataFrame:
    """Links (a, b) whose components hold every similar pair; from node, sketch and chosen of distinct sets."""
    star = "a binary, b binary"
    level = nodes.select(F.posexplode("chosen").alias("run", "shingle"), "node", "sketch").select(F.xxhash64("run", "shingle").alias("path"), "node", "sketch")
    found = []
    for depth in range(depths + 1):
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        level = work.save(level.join(sizes, "path"), f"level{depth}")
        compared = level.filter(F.col("n") <= small).select("path", "node", "sketch")
        compared = compared.repartition(F.col("path")).sortWithinPartitions("path", "node")
        found.append(work.save(compared.mapInArrow(_brute_force, star), f"found{depth}"))
        large = level.filter(F.col("n") > small)
        if large.limit(1).count() == 0:
            break
        # A large bucket whose nodes all agree with its first one is one star and needs no splitting.
        leaders = large.groupBy("path").agg(F.min(F.struct("node", "sketch")).alias("first"))
        large = large.join(leaders, "path").withColumn("near", _agreement(F.col("sketch"), F.col("first.sketch")) >= round(AGREE * SKETCH))
        loose = large.groupBy("path").agg(F.min("near").alias("tight"))
        large = work.save(large.join(loose, "path").select("path", "node", "sketch", F.col("first.node").alias("low"), (F.col("tight") | F.lit(depth == depths)).alias("done")), f"large{depth}")
        found.append(large.filter(F.col("done") & (F.col("node") != F.col("low"))).select(F.col("node").alias("a"), F.col("low").alias("b")))
        turns = F.transform(F.sequence(F.lit(0), F.lit(BRANCHES - 1)), lambda i: F.pmod(F.xxhash64("path", i), F.lit(SKETCH)).cast("int"))
        level = large.filter(~F.col("done")).select("node", "sketch", "path", F.explode(F.array_distinct(turns)).alias("turn"))
        level = level.select(F.xxhash64("path", "turn", F.substring("sketch", F.col("turn") + 1, F.lit(1))).alias("path"), "node", "sketch")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None) -> Iterator[tuple[int, int, np.ndarray]]:
    """Strips (i, j, sizes) of intersections: of sets from the i-th on with the others (j is 0), or with the sets from the j-th on (j is i)."""
    every = sets if others is None else sets + others
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    _, place, df = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    shared = df[place] > 1
    owner, place = owner[shared], place[shared]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    n, m = len(sets), len(every)
    width = max(1, min(2048, CELLS // m))
    rows = max(1, CELLS // max(1, n if others is None else m - n))
    for lo in range(0, n, rows):
        hi, begin = min(n, lo + rows), lo if others is None else n
        named = np.zeros(len(df), bool)  # only what the strip holds
        named[place[(owner >= lo) & (owner < hi)]] = True
        held = named[place] & (((owner >= lo) & (owner < hi)) | (owner >= begin))
        who, what = owner[held], (np.cumsum(named) - 1)[place[held]]
        out = np.zeros((hi - lo, m - begin), np.float32)
        for a in range(0, int(named.sum()), width):
            x, y = np.searchsorted(what, (a, a + width))
            has = np.zeros((m, width), np.float32)
            has[who[x:y], what[x:y] - a] = 1
            out += has[lo:hi] @ has[begin:].T
        yield lo, lo if others is None else 0, out


def _similar(sets: list[np.ndarray], others: list[np.ndarray] | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Similar pairs, strip by strip: places in sets and in the others, or the lower and the higher place in sets."""
    left = np.array([len(s) for s in sets])
    right = left if others is None else np.array([len(s) for s in others])
    for i, j, sizes in _overlaps(sets, others):
        both = sizes.astype(np.float64)
        near = both >= threshold * (left[i : i + len(both), None] + right[None, j:] - both) - 1e-9
        a, b = np.nonzero(np.triu(near, 1) if others is None else near)
        yield a + i, b + j


def _verify(shingle: int, threshold: float):
    """Links of the nodes within each task key: counts, and stars that connect them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, "task", 256):
            nodes, side, n_parts = t["node"].to_pylist(), t["side"].to_pylist(), t["crossed"].to_pylist()
            sets = list(shingle_sets(t["text"].to_pylist(), shingle))
            edges = _group_edges(t["task"].to_numpy())
            rows: list[tuple[bytes, bytes, int]] = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                members = sorted(range(lo, hi), key=lambda i: nodes[i])
                if n_parts[lo]:
                    first = [i for i in members if side[i] == 0]
                    second = [i for i in members if side[i] == 1]
                    if not first or not second:
                        continue
                    found, members, after = _similar([sets[i] for i in first], [sets[i] for i in second], threshold), first + second, len(first)
                else:
                    found, after = _similar([sets[i] for i in members], None, threshold), 0
                n = len(members)
                links, root = np.zeros(n, np.int64), np.arange(n)
                for a, b in found:
                    links += np.bincount(a, minlength=n) + np.bincount(b + after, minlength=n)
                    root = _roots(n, np.append(np.arange(n), a), np.append(root, b + after))
                rows += [(nodes[members[i]], nodes[members[root[i]]], int(links[i])) for i in np.flatnonzero(links).tolist()]
            yield pa.RecordBatch.from_pydict({
                "node": pa.array([r[0] for r in rows], pa.binary()),
                "root": pa.array([r[1] for r in rows], pa.binary()),
                "n_links": pa.array([r[2] for r in rows], pa.int64()),
            })

    return task


def _row_key() -> Column:
    """Tells rows of one doc_id apart, and finds the text of a chosen row again."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("binary"))


def missed(threshold: float, runs: int) -> float:
    """The share of pairs at the threshold that never share a bucket, or whose sketches agree too little."""
    few = (math.comb(SKETCH, k) * threshold**k * (1 - threshold) ** (SKETCH - k) for k in range(round(AGREE * SKETCH)))
    return (1 - threshold) ** runs + sum(few)


def runs_for(threshold: float, recall: float) -> int:
    """How many runs reach the recall; an error if those that a sketch allows do not."""
    for runs in range(1, SKETCH + 1):
        if missed(threshold, runs) <= 1 - recall:
            return runs
    raise ValueError(f"at a threshold of {threshold} the recall is {1 - missed(threshold, SKETCH):.9f} at most")


def classes(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Rows with words (doc_id, row_key, root: a key of the class, class_id, n_links, n_copies), and doc_id of rows without."""
    work = Workspace(docs.sparkSession)
    runs = runs_for(threshold, recall)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).withColumn("row_key", _row_key())
    sets = work.save(docs.mapInArrow(_sets(shingle, runs), SETS), "sets")
    some = sets.filter("node IS NOT NULL")
    one = F.min(F.struct(F.col("doc_id"), F.col("row_key"), F.col("size"), F.col("sketch"), F.col("chosen")))
    nodes = some.groupBy("node").agg(one.alias("one"), F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("low_id"))
    nodes = work.save(nodes.select("node", "n_copies", "low_id", "one.*"), "nodes")
    near = work.save(components(candidates(nodes, work)), "near")
    for depth in range(DEPTH + 1):
        for name in ("level", "found", "large"):
            work.drop(f"{name}{depth}")

    # One task for each component, or for each pair of its parts: parts a <= b, side 1 for those of b.
    near = near.join(nodes.select("node", "doc_id", "row_key", "size"), "node")
    parts = near.groupBy("root").agg(F.ceil(F.greatest(F.sum("size") / PART, F.count(F.lit(1)) / PART_NODES)).cast("int").alias("parts"))
    near = near.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    near = near.select("root", "node", "doc_id", "row_key", "part", F.explode(others).alias("other")).select(
        F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other")).alias("task"),
        (F.col("part") > F.col("other")).cast("int").alias("side"),
        (F.col("part") != F.col("other")).alias("crossed"),
        "node", "doc_id", "row_key",
    )
    wanted = near.select("doc_id", "row_key", "node").distinct()
    same = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["row_key"] == wanted["row_key"])
    texts = docs.join(wanted, same).select(wanted["node"], docs["text"]).dropDuplicates(["node"])
    dealt = near.select("task", "side", "crossed", "node").join(texts, "node")
    dealt = dealt.repartition(F.col("task")).sortWithinPartitions("task")
    verified = work.save(dealt.mapInArrow(_verify(shingle, threshold), VERIFIED), "verified")

    found = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    ids = nodes.select("node", "low_id", "n_copies").join(found, "node", "left").join(links, "node", "left")
    ids = ids.withColumn("root", F.coalesce("root", "node"))
    lowest = ids.groupBy("root").agg(F.min("low_id").alias("class_id"))
    ids = ids.join(lowest, "root").select("node", "root", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    return some.select("doc_id", "row_key", "node").join(work.save(ids, "classes"), "node").drop("node"), sets.filter("node IS NULL").select("doc_id")


def join(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, n_copies for every row."""
    linked, alone = classes(docs, threshold, shingle, recall)
    alone = alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return linked.select("doc_id", "class_id", "n_links", "n_copies").union(alone)


def keep_one(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, recall: float = RECALL) -> DataFrame:
    """One row of docs for each class, of its smallest doc_id; rows without words all stay."""
    linked, _ = classes(docs, threshold, shingle, recall)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    kept = linked.groupBy("root").agg(first.alias("first")).select(F.col("first.doc_id").alias("_kept_id"), F.col("first.row_key").alias("_kept_key"))
    # Of rows that share doc_id and text, the same one stays in every run; it is chosen by keys, without the texts.
    others = F.xxhash64(F.to_json(F.struct(F.lit(0), *(F.col(f"`{c}`") for c in docs.columns if c != "text")))).alias("_others")
    keys = docs.select(_row_key().alias("_kept_key"), others)
    kept = kept.join(keys, "_kept_key").groupBy("_kept_id", "_kept_key").agg(F.min("_others").alias("_kept_others"))
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns), _row_key().alias("_row_key"), others)
    has_words = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    same_id = (F.col("doc_id") == F.col("_kept_id")) | (F.col("doc_id").isNull() & F.col("_kept_id").isNull())
    same = (F.col("_row_key") == F.col("_kept_key")) & (F.col("_others") == F.col("_kept_others")) & same_id
    chosen = rows.filter(has_words).join(kept, same).dropDuplicates(["_row_key"])
    return chosen.select(*docs.columns).union(rows.filter(~has_words).select(*docs.columns))

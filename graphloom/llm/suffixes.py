"""Suffix-array dedup by deep-shallow sorting.

Suffixes are sampled by content (see repeats.py), so that any repeat of the full
length has suffixes sampled at the same distance from its start in all its places.
Those whose first bytes repeat are sorted twice, as they read onwards and, reversed,
as they read back: multikey quicksort on eight bytes at a time down to a shallow
depth, then a blind trie for each group that still agrees, which compares a suffix
with one other only. From the two orders and their common prefixes follows exactly
which windows around a sampled suffix equal another's.

Equal surroundings count once before any sorting. The suffixes that share a first
gram are sorted together up to a block; more are dealt to blocks, and what a block
can't settle is settled among blocks by the content of single windows.

Null and empty texts have no bytes. Repeated rows are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common, repeats

LENGTH, GRAM = 200, 32
#: Depth to which quicksort goes, the bytes it looks at in a step, and suffixes of a block.
SHALLOW, STEP, BLOCK = 40, 8, 4096


def common_prefix(a: int, b: int, size: int) -> int:
    """Of two strings of `size` bytes, read as big-endian numbers."""
    return (8 * size - (a ^ b).bit_length()) >> 3


class BlindTrie:
    """Holds only the depths at which strings part and the bytes there; a string is compared in full with one other."""

    def __init__(self, texts: list[bytes], numbers: list[int], size: int):
        self.texts, self.numbers, self.size, self.root = texts, numbers, size, None

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = [i]
            return
        text, node = self.texts[i], self.root
        while isinstance(node, tuple):
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        depth = common_prefix(self.numbers[i], self.numbers[node[0]], self.size)
        if depth == self.size:
            node.append(i)
            return
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            above, node = node, node[1][text[node[0]]]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][text[depth]] = [i]
            return
        below = node
        while isinstance(below, tuple):
            below = next(iter(below[1].values()))
        split = (depth, {self.texts[below[0]][depth]: node, text[depth]: [i]})
        if above is None:
            self.root = split
        else:
            above[1][text[above[0]]] = split

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                out.extend(node)
        return out


def deep_shallow(texts: list[bytes], numbers: list[int], ids: list[int], size: int) -> tuple[list[int], list[int]]:
    """ids in the order of their texts, all of `size` bytes, and the common prefix of each with the one before (-1 for the first)."""
    out: list[int] = []
    stack = [(ids, 0)]
    while stack:
        some, depth = stack.pop()
        if len(some) == 1:
            out.append(some[0])
        elif depth >= min(SHALLOW, size):
            trie = BlindTrie(texts, numbers, size)
            for i in some:
                trie.insert(i)
            out += trie.order()
        else:
            stop = depth + STEP
            keys = [texts[i][depth:stop] for i in some]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less = [i for i, k in zip(some, keys, strict=True) if k < pivot]
            same = [i for i, k in zip(some, keys, strict=True) if k == pivot]
            if len(less) + len(same) < len(some):
                stack.append(([i for i, k in zip(some, keys, strict=True) if k > pivot], depth))
            stack.append((same, stop))
            if less:
                stack.append((less, depth))
    return out, [-1, *(common_prefix(numbers[a], numbers[b], size) for a, b in zip(out, out[1:]))]


def _orders(group: np.ndarray, texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow order and common prefixes, group by group."""
    texts = [t.ljust(size, b"\0") for t in texts]
    numbers = [int.from_bytes(t) for t in texts]
    order, shared = [], []
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])).tolist()
    for a, b in zip(bounds, bounds[1:]):
        o, s = deep_shallow(texts, numbers, list(range(a, b)), size)
        order += o
        shared += s
    return np.array(order), np.array(shared)


def window_classes(group: np.ndarray, onwards: list[bytes], back: list[bytes], near: np.ndarray, far: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each distance t from a window's start to the sampled suffix: the rows that have such a window, and a class number for each, equal where the windows are."""
    n = len(group)
    order, shared = _orders(group, onwards, length)
    order_back, shared_back = _orders(group, back, int(far.max()) if n and far.max() else 1)
    onto, onto_back = np.empty(n, np.int64), np.empty(n, np.int64)
    for t in range(int(near.min()), int(far.max()) + 1):
        rows = np.flatnonzero((near <= t) & (t <= far))
        if len(rows):
            onto[order] = np.cumsum(shared < length - t)
            onto_back[order_back] = np.cumsum(shared_back < t)
            yield t, rows, onto[rows] * (n + 1) + onto_back[rows]


def _contexts(need: DataFrame, texts: DataFrame) -> DataFrame:
    """The bytes around each sampled suffix, from the start of its first window to the end of its last."""
    joined = repeats.per_text(need, "v c n contents p near far").join(repeats.packed_texts(texts), repeats.TEXT).select(*repeats.TEXT, "found", "z")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["v", "c", "n", "contents", "p", "near", "far"]
        for whole in batches:
            for batch in repeats.pieces(whole, "found", 20_000):
                bounds, found = repeats.listed(batch, "found")
                starts, stops, some = (found["p"] - found["far"]).tolist(), (found["p"] - found["near"] + LENGTH).tolist(), []
                for i, z in enumerate(batch.column("z")):
                    raw = repeats.unpacked(z.as_py())
                    some += [raw[starts[k] : stops[k]] for k in range(bounds[i], bounds[i + 1])]
                of = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(bounds)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in repeats.TEXT), *(pa.array(found[k].astype(np.int64)) for k in names), pa.array(some, pa.binary())], names=[*repeats.TEXT, *names, "around"])

    return joined.mapInArrow(work, "did long, tx long, th long, v long, c long, n long, contents long, p long, near long, far long, around binary")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (a, b) of repeated windows of suffixes whose surroundings are unique (x null); and of groups in several blocks a row for each class of windows (x, y its hashes, a its start, m how often it was met)."""
    names = [*repeats.TEXT, "a", "b", "x", "y", "m"]
    for table, group in common.whole_groups(batches, ["v", "block"]):
        cols = {k: table.column(k).to_numpy() for k in (*repeats.TEXT, "n", "p", "near", "far", "blocks")}
        around = table.column("around").to_pylist()
        onwards = [x[f:] for x, f in zip(around, cols["far"].tolist(), strict=True)]
        back = [x[:f][::-1] for x, f in zip(around, cols["far"].tolist(), strict=True)]
        spans: list[np.ndarray] = []
        classes: list[tuple[np.ndarray, ...]] = []
        for t, rows, kind in window_classes(group, onwards, back, cols["near"], cols["far"]):
            _, first, number, count = np.unique(kind, return_index=True, return_inverse=True, return_counts=True)
            hit = rows[(count[number] > 1) & (cols["n"][rows] == 1)]
            spans.append(np.stack([hit, np.full(len(hit), t)]))
            far_group = np.flatnonzero(cols["blocks"][rows[first]] > 1)
            if len(far_group):
                some = rows[first[far_group]]
                often = np.bincount(number, weights=np.minimum(cols["n"][rows], 2))[far_group].astype(np.int64)
                windows = [around[i][f - t : f - t + LENGTH] for i, f in zip(some.tolist(), cols["far"][some].tolist(), strict=True)]
                raw = np.frombuffer(b"".join(windows), np.uint8)
                starts = np.arange(len(windows)) * LENGTH
                hashes = [repeats.mixed(np.add.reduceat(repeats._BYTES[k][raw] * np.tile(repeats.Powers.of(k, LENGTH)[0][:LENGTH], len(windows)), starts)) for k in (0, 1)]
                classes.append((*(cols[k][some] for k in repeats.TEXT), cols["p"][some] - t, *(h.view(np.int64) for h in hashes), often))
        if spans:
            row, t = np.concatenate(spans, axis=1)
            at = np.lexsort((t, row))
            row, t = row[at], t[at]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (t[1:] != t[:-1] + 1)]) if len(row) else np.zeros(0, bool)
            low = np.flatnonzero(new)
            high = np.concatenate([low[1:], [len(row)]]) - 1 if len(row) else low
            r = row[low]
            a, b = cols["p"][r] - t[high], cols["p"][r] - t[low] + LENGTH
            void = pa.nulls(len(r), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(cols[k][r]) for k in repeats.TEXT), pa.array(a), pa.array(b), void, void, void], names=names)
        if classes:
            did, tx, th, s, x, y, m = (np.concatenate(k) for k in zip(*classes, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(did), pa.array(tx), pa.array(th), pa.array(s), pa.array(s + LENGTH), pa.array(x), pa.array(y), pa.array(m)], names=names)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (from and to in bytes, flat) and kept (bytes left) for every row."""
    kind = repeats.Kind(False, LENGTH, GRAM)
    texts = repeats.corpus(docs, id_col, text_col)
    again = common.written(repeats.segment_table(texts, kind).groupBy("v").agg(F.count("*").alias("n")).filter("n > 1").select("v"), "grams")
    rep = common.written(repeats.segment_table(texts, kind, repeats.bitmap_of(again)).join(again, "v"), "segments")
    same = common.written(rep.groupBy("v", "c").agg(F.count("*").alias("n"), F.min(F.struct("did", "tx", "q")).alias("r")).select("v", "c", "n", "r.did", "r.tx", "r.q"), "surroundings")
    fields = [f"{x} AS {k}" for k, x in repeats.FIELDS.items()]
    whole = rep.join(same.filter("n > 1").select("v", "c"), ["v", "c"]).selectExpr("did", "tx", *fields)
    spans = whole.select(*repeats.TEXT, (F.col("p") - F.col("far")).alias("a"), (F.col("p") - F.col("near") + LENGTH).alias("b"))
    several = same.groupBy("v").agg(F.count("*").alias("contents")).filter("contents > 1")
    need = same.join(several, "v").selectExpr("v", "c", "n", "contents", "did", "tx", *fields)
    parts = common.partitions(docs.sparkSession)
    around = _contexts(need, texts).withColumn("blocks", F.ceil(F.col("contents") / BLOCK)).withColumn("block", F.pmod("c", F.col("blocks")))
    settled = common.written(around.repartition(parts, "v", "block").sortWithinPartitions("v", "block").mapInArrow(_settle, "did long, tx long, th long, a long, b long, x long, y long, m long"), "settled")
    open_ = settled.filter("x IS NOT NULL")
    met = open_.groupBy("x", "y").agg(F.sum("m").alias("met")).filter("met > 1")
    spans = spans.unionByName(settled.filter("x IS NULL").select(*repeats.TEXT, "a", "b")).unionByName(open_.filter("m = 1").join(met, ["x", "y"]).select(*repeats.TEXT, "a", "b"))
    joined = repeats.packed_texts(texts).join(repeats.removed_spans(spans), repeats.TEXT, "left").select("doc_id", "z", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "z", 1 << 20):
                out: list[list] = [[], [], [], []]
                for z, spans in zip(batch.column("z"), batch.column("spans"), strict=True):
                    raw, flat = repeats.unpacked(z.as_py()), spans.as_py() or []
                    kept = b"".join(raw[a:b] for a, b in zip([0, *flat[1::2]], [*flat[::2], len(raw)], strict=True))
                    for x, y in zip(out, (len(raw), len(raw) - len(kept), len(flat) // 2, kept), strict=True):
                        x.append(y)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:3]), batch.column("spans"), pa.array(out[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<bigint>, kept binary")


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_bytes(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

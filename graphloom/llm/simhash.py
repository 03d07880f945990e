"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint's 64 bits are 32 segments of two; its embedding is the number of ones
in each segment. The Manhattan distance of two embeddings is never more than the
Hamming distance of the fingerprints, so it is a lower bound to join on. Written in
unary (at least one, both), an embedding is again 64 bits and its Manhattan distance
a count of differing bits. The grid: segments are dealt to groups; at distance three or
less all but three groups agree exactly, so every near pair meets in a cell that names
all groups but three and their counts. The more fingerprints there are, the more groups
and the finer the cells, so that a cell's chance company stays small; the links are the
same. In a cell the bound is tested, then the fingerprints themselves. A cell gives a spanning forest of its
links, never all its pairs; a cell of many fingerprints is dealt out as pairs of
blocks to many tasks. Equal fingerprints are one node from the start.

Repeated rows are rows of their own in one component; a very long text is hashed in
bounded steps. Null and empty texts, and texts without words, have fingerprint zero and link like
any other. A component's id is its smallest doc_id; rows without a doc_id link but
never name a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common
from graphloom.llm.components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: How many groups the 32 segments may be dealt to, and the bits of chance that a segment's count has.
GROUPS, CHANCE = (6, 8, 10, 12, 16), 1.5
#: Fingerprints of a block of a large cell.
BLOCK = 2048

_LOW = np.uint64(0x5555555555555555)


def hashes(text: str, size: int) -> np.ndarray:
    """A hash for each shingle of so many words; one of all words where they are fewer, none without words."""
    words = text.encode().lower().split()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))), np.uint64, len(words) - size + 1)


def fingerprint(text: str, size: int = SHINGLE) -> int:
    return fingerprint_of(hashes(text, size))


def fingerprint_of(h: np.ndarray) -> int:
    """The fingerprint of a text's shingles, repeats included."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded working memory for long texts
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (64 bits as a long) for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, size=4 << 20):
                fp = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return common.keyed(docs, id_col, text_col).mapInArrow(work, "doc_id long, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """The counts of the two-bit segments in unary: the low bit says one or two, the high bit says two."""
    low, high = fp & _LOW, (fp >> np.uint64(1)) & _LOW
    return (low | high) | ((low & high) << np.uint64(1))


def groups_for(n: int) -> int:
    """The number of groups that gives n fingerprints the fewest places and chance meetings together."""
    return min(GROUPS, key=lambda g: comb(g, DISTANCE) * (1 + n * 2 ** (-CHANCE * 32 * (g - DISTANCE) / g)))


def cells(groups: int) -> list[np.uint64]:
    """For each cell the bits of the embedding that it fixes."""
    masks, at = [], 0
    for k in range(groups):
        size = 2 * (32 // groups + (k < 32 % groups))
        masks.append(((1 << size) - 1) << at)
        at += size
    return [np.uint64(sum(masks[g] for g in c)) for c in combinations(range(groups), groups - DISTANCE)]


def _places(prints: DataFrame, groups: int) -> DataFrame:
    """(cell, counts, fp): a row for each cell of each fingerprint."""
    masks = cells(groups)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            counts = embed(fp)
            for k, mask in enumerate(masks):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), pa.array((counts & mask).view(np.int64)), batch.column("fp")], names=["cell", "counts", "fp"])

    return prints.select("fp").mapInArrow(work, "cell int, counts long, fp long")


def near_pairs(group: np.ndarray, side: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows come sorted by group. A spanning forest of the near pairs of each group, as two arrays of row numbers; in groups of two blocks only pairs across are tried. side: 2 where a group is one block."""
    n = len(fp)
    counts, root = embed(fp), np.arange(n)
    left, right = [], []
    i, step = np.arange(n), 1
    while True:
        i = i[i + step < n]
        i = i[group[i] == group[i + step]]
        if not len(i):
            break
        j = i + step
        near = (side[i] != side[j]) | (side[i] == 2)
        near &= np.bitwise_count(counts[i] ^ counts[j]) <= DISTANCE
        a, b = i[near], j[near]
        ok = (np.bitwise_count(fp[a] ^ fp[b]) <= DISTANCE) & (root[a] != root[b])
        joined = False
        for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            rx, ry = x, y
            while root[rx] != rx:
                rx = root[rx]
            while root[ry] != ry:
                ry = root[ry]
            if rx != ry:
                root[max(rx, ry)] = min(rx, ry)
                left.append(x)
                right.append(y)
                joined = True
        while joined and (root != (up := root[root])).any():
            root = up
        step += 1
    return np.array(left, np.int64), np.array(right, np.int64)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, group in common.whole_groups(batches, ["cell", "counts", "a", "b"]):
        fp = t.column("fp").to_numpy()
        x, y = near_pairs(group, t.column("side").to_numpy(), fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(fp[x]), pa.array(fp[y])], names=["u", "v"])


def links(prints: DataFrame, block: int = BLOCK, groups: int | None = None) -> DataFrame:
    """(u, v): links between distinct fingerprints whose closure is that of all links at DISTANCE or less."""
    places = _places(prints, groups or groups_for(prints.count()))
    sizes = places.groupBy("cell", "counts").agg(F.count("*").alias("n")).filter("n > 1")
    met = places.join(sizes, ["cell", "counts"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("blocks")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cell", "counts", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") < F.col("other")).cast("int")).alias("side"), "fp")
    dealt = met.repartition(common.partitions(prints.sparkSession), "cell", "counts", "a", "b").sortWithinPartitions("cell", "counts", "a", "b")
    return dealt.mapInArrow(_forest, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id for every row."""
    prints = common.written(fingerprints(docs, id_col, text_col), "prints")
    distinct = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(distinct))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(by_print, prints["fp"] == by_print["_fp"]).select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: near copies by five-word shingles, their fingerprints joined as here and their whole sets compared."""
    from graphloom.llm import near

    return near.keep_one(docs)

"""Near copies by the Jaccard similarity of word shingles.

A text is the set of its five-word shingles, as 64-bit hashes. Two texts are near
copies if the sets' similarity is four fifths or more. Candidates come by SimHash:
fingerprints of the five-word shingles, linked within three bits by the segment-popcount
embedding of simhash.py. Near copies may differ in more bits than the grid reaches
(about ten at similarity 0.8); those share a band of MinHash values: at similarity 0.8 a pair has none of the 24 bands of four values in
common with a probability of 3 in a million, above it with less. Texts joined by fingerprints or bands
go to one place, where those that share a band or a component of fingerprints are compared by their whole sets; a
place of many texts is dealt out as pairs of blocks to many tasks. A place gives a
spanning forest of its links, never all its pairs. Equal texts, known by 128 bits, are
one node from the start.

Null and empty texts, and texts without words, are copies of each other. A text of
fewer words than a shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import common, simhash
from graphloom.llm.components import components

#: Words of a shingle, and the least similarity of near copies as a fraction.
WORDS, LEAST = 5, (4, 5)
#: Bands, and MinHash values of a band.
BANDS, ROWS = 24, 4
#: What a text may share with a candidate: its bands, and behind them the component of its fingerprint.
SHARED = BANDS + 1
#: Texts of a block of a large place.
BLOCK = 2048

_TURN, _TIMES = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_TIMES |= np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of a text's shingles in order."""
    return np.unique(simhash.hashes(text, WORDS))


def bands(own: np.ndarray) -> np.ndarray:
    """One number for each band of a set of shingles; zeros for the empty set."""
    if not len(own):
        return np.zeros(BANDS, np.uint64)
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(own), 1 << 12):  # bounded working memory for long texts
        np.minimum(least, ((own[None, at : at + (1 << 12)] ^ _TURN) * _TIMES).min(axis=1), out=least)
    out, values = np.zeros(BANDS, np.uint64), least.reshape(BANDS, ROWS)
    for k in range(ROWS):
        out = (out ^ values[:, k]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach the least similarity."""
    most, of = LEAST
    if not len(a) or not len(b):
        return len(a) == len(b)
    if min(len(a), len(b)) * of < max(len(a), len(b)) * most:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * of >= (len(a) + len(b) - shared) * most


def text_key(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, bands (as bytes) and fp, the fingerprint, for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, size=4 << 20):
                found, prints = [], np.empty(batch.num_rows, np.uint64)
                for k, text in enumerate(batch.column("text").to_pylist()):
                    h = simhash.hashes(text, WORDS)
                    found.append(bands(np.unique(h)).tobytes())
                    prints[k] = simhash.fingerprint_of(h)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(found, pa.binary()), pa.array(prints.view(np.int64))], names=["doc_id", "key", "bands", "fp"])

    return common.keyed(docs, id_col, text_col).withColumn("key", text_key(F.col("text"))).mapInArrow(work, "doc_id long, key binary, bands binary, fp long")


def joined_prints(distinct: DataFrame) -> DataFrame:
    """distinct (key, least, bands, fp) with the component of the fingerprint behind the bands; components by op7's embedding, grid and Hamming test."""
    roots = components(simhash.links(common.written(distinct.select("fp").distinct(), "fingerprints")))
    of = distinct.join(roots.toDF("fp", "root"), "fp", "left")
    value = F.to_binary(F.lpad(F.hex(F.coalesce("root", "fp")), 16, "0"), F.lit("hex"))
    return of.select("key", "least", F.concat("bands", value).alias("bands"))


def _places(distinct: DataFrame) -> DataFrame:
    """(band, value, key): a row for each band of each text and one for the component of its fingerprint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64).reshape(-1, SHARED)
                for k in range(SHARED):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(values[:, k].copy()), batch.column("key")], names=["band", "value", "key"])

    return distinct.select("key", "bands").mapInArrow(work, "band int, value long, key binary")


def near_pairs(side: np.ndarray, values: np.ndarray, texts: list[str]) -> list[tuple[int, int]]:
    """A spanning forest of the near copies among texts that share a band or a component of fingerprints; of two blocks only pairs across are tried. side: 2 where all is one block."""
    n, out = len(side), []
    root, sets = np.arange(n), {}

    def own(x: int) -> np.ndarray:
        if x not in sets:
            sets[x] = shingles(texts[x])
        return sets[x]

    for step in range(1, n):
        i = np.arange(n - step)
        i = i[(root[i] != root[i + step]) & ((side[i] != side[i + step]) | (side[i] == 2))]
        i = i[(values[i] == values[i + step]).any(axis=1)]
        for x in i.tolist():
            a, b = root[x], root[x + step]
            if a != b and similar(own(x), own(x + step)):
                root[root == max(a, b)] = min(a, b)
                out.append((x, x + step))
    return out


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, group in common.whole_groups(batches, ["place", "a", "b"]):
        ends = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(group)]
        for start, stop in zip(ends, ends[1:], strict=False):
            part = t.slice(start, stop - start)
            values = np.frombuffer(b"".join(part.column("bands").to_pylist()), np.int64).reshape(-1, SHARED)
            keys = part.column("key").to_pylist()
            pairs = near_pairs(part.column("side").to_numpy(), values, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([keys[x] for x, _ in pairs], pa.binary()), pa.array([keys[y] for _, y in pairs], pa.binary())], names=["u", "v"])


def _links(texts: DataFrame, distinct: DataFrame, block: int) -> DataFrame:
    """(u, v): links between keys of different texts whose closure is that of all near copies. texts: key and text, also repeated."""
    places = _places(distinct)
    shared = places.groupBy("band", "value").agg(F.min("key").alias("least"), F.count("*").alias("n")).filter("n > 1")
    joined = places.join(shared, ["band", "value"]).filter("key <> least").select(F.col("key").alias("u"), F.col("least").alias("v"))
    met = common.written(components(joined), "met")
    met = met.join(met.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "root")
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") < F.col("other")).cast("int"))
    met = met.select(F.xxhash64("root").alias("place"), F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), side.alias("side"), F.col("node").alias("key"))
    once = texts.join(met.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    dealt = met.join(distinct.select("key", "bands"), "key").join(once, "key")
    dealt = dealt.select("place", "a", "b", "side", "key", "bands", "text").repartition(common.partitions(texts.sparkSession), "place", "a", "b").sortWithinPartitions("place", "a", "b")
    return dealt.mapInArrow(_forest, "u binary, v binary").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, key and component_id, the smallest doc_id of all that near copies join, for every row. Rows without a doc_id link but never name a component."""
    signed = common.written(_signed(docs, id_col, text_col), "signed")
    distinct = common.written(joined_prints(signed.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("bands").alias("bands"), F.min("fp").alias("fp"))), "distinct")
    texts = common.keyed(docs, id_col, text_col).select(text_key(F.col("text")).alias("key"), "text")
    roots = components(_links(texts, distinct, block))
    named = distinct.join(roots, distinct["key"] == roots["node"], "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = named.join(least, "root").select(F.col("key").alias("_key"), "component_id")
    return signed.join(by_key, signed["key"] == by_key["_key"]).select("doc_id", "key", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of every group of near copies the document with the smallest doc_id; same columns. Of rows that repeat a doc_id all stay."""
    found = near_copies(docs).filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    return docs.join(found, (docs["doc_id"] == found["_id"]) & (text_key(docs["text"]) == found["_key"]), "left_anti")

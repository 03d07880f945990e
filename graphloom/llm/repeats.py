"""Repeated windows of a fixed length in a corpus: what substring and suffix-array dedup share.

A text is a row of units, bytes or words. Hashes of `gram` units are sampled by
content: every window of `length` units is filed under its least gram (leftmost of
equals), so equal windows are always filed alike. Consecutive windows filed under
one place are a segment. Level by level, only what repeats goes on: first a gram
must repeat, then the whole segment's content is compared by hash, and only segments
that share a gram but differ in content are looked at window by window.

No document id is assumed unique: a text is known by its id and 79 bits of itself (tx
and th), so that texts which share an id, or have none, are never taken for one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import common

#: Window starts handled at once; places within fit into so many bits.
PLACE_BITS = 20
STEP = (1 << PLACE_BITS) - (1 << 12)
_PLACE = np.uint64((1 << PLACE_BITS) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_RNG = np.random.default_rng(20_240_501)
_BYTES = [_RNG.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1) for _ in _BASES]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


@dataclass(frozen=True)
class Kind:
    """Which windows: of `words` or bytes, their length, and the length of the sampled grams."""

    words: bool
    length: int
    gram: int


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse; the longest tables asked for are kept."""

    _made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if which not in cls._made or len(cls._made[which][0]) < n:
            size, base = 1 << max(16, int(n - 1).bit_length()), _BASES[which]
            up, down = np.full(size, np.uint64(base)), np.full(size, np.uint64(pow(base, -1, 1 << 64)))
            up[0] = down[0] = 1
            cls._made[which] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls._made[which]


class Hashes:
    """Hashes of any run of units of a buffer, in constant time each."""

    def __init__(self, units: np.ndarray, which: int = 0):
        self.up, self.down = Powers.of(which, len(units) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * self.up[: len(units)], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start])

    def all(self, n: int) -> np.ndarray:
        """Of every run of n units."""
        m = len(self.sums) - n
        return mixed((self.sums[n:] - self.sums[:-n]) * self.down[:m]) if m > 0 else np.zeros(0, np.uint64)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte buffer."""
    gap = np.concatenate([[True], _SPACE[raw], [True]])
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def units(kind: Kind, raw: np.ndarray, which: int = 0, bounds: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    if not kind.words:
        return _BYTES[which][raw]
    starts, ends = bounds or word_bounds(raw)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # in runs of whole words, for bounded powers
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << PLACE_BITS), "right")))
        at = int(starts[i])
        out[i:j] = Hashes(_BYTES[which][raw[at : int(ends[j - 1])]], which)(starts[i:j] - at, ends[i:j] - at)
        i = j
    return out


def segments(kind: Kind, u: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (gram hash, place of the gram, least and greatest distance from a window's start to it, content hash), by steps of a text."""
    span = kind.length - kind.gram + 1
    for at in range(0, max(0, len(u) - kind.length + 1), STEP):
        part = u[at : at + STEP + kind.length - 1]
        hashes = Hashes(part)
        h = hashes.all(kind.gram)
        keyed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        n = len(h) - span + 1
        rows = -(-len(h) // span)
        grid = np.full(rows * span, ~np.uint64(0))
        grid[: len(h)] = keyed
        grid = grid.reshape(rows, span)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        p = place[first]
        near, far = p - last, p - first
        content = hashes(first, last + kind.length) ^ mixed((near * 1_000_003 + far + 1).astype(np.uint64))
        yield h[p], p + at, near, far, content


#: What a text is known by.
TEXT = ["did", "tx", "th"]


def corpus(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, did (a null id counts as before all others), tx (64 bits of the text's hash), th (15 bits of another) and text."""
    return common.rows_known(docs, id_col, text_col).select("doc_id", "did", F.col("x").alias("tx"), F.col("y").bitwiseAND(0x7FFF).alias("th"), "text")


#: Bits of the bitmap of repeated grams; a fuller one only lets more rows through.
BITMAP_BITS = 27


def segment_table(texts: DataFrame, kind: Kind, bitmap=None) -> DataFrame:
    """(v, did, tx, q, c): every segment of every text; q packs th, p, near and far (see FIELDS). With a bitmap only those whose gram may repeat."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for whole in batches:
            for batch in common.slices(whole, size=4 << 20):
                ids = batch.column("did").to_numpy(zero_copy_only=False)
                whole_hash, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tx", "th"))
                made: list[list[np.ndarray]] = [[], [], [], [], []]
                for i, text in enumerate(batch.column("text").to_pylist()):
                    for v, p, near, far, c in segments(kind, units(kind, np.frombuffer(text.encode(), np.uint8))):
                        if seen is not None:
                            at = (v >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                            on = np.flatnonzero((seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                            v, p, near, far, c = v[on], p[on], near[on], far[on], c[on]
                        made[0].append(v.view(np.int64))
                        made[1].append(np.full(len(v), ids[i]))
                        made[2].append(np.full(len(v), whole_hash[i]))
                        made[3].append((hashes[i] << 48) | (p << 16) | (near << 8) | far)
                        made[4].append(c.view(np.int64))
                if made[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in made], names=["v", "did", "tx", "q", "c"])

    return texts.select(*TEXT, "text").mapInArrow(work, "v long, did long, tx long, q long, c long")


#: What q holds: windows are at most 256 units longer than their grams and texts have under 2^32 units.
FIELDS = {"th": "shiftright(q, 48)", "p": "shiftright(q, 16) & 4294967295L", "near": "shiftright(q, 8) & 255", "far": "q & 255"}


def bitmap_of(grams: DataFrame):
    """A broadcast bitmap of grams (v), of a fixed size whatever the corpus."""
    bucket = F.shiftrightunsigned("v", 64 - BITMAP_BITS)
    rows = grams.groupBy(F.shiftright(bucket, 15).alias("k")).agg(F.expr(f"bitmap_construct_agg(shiftrightunsigned(v, {64 - BITMAP_BITS}) & 32767)").alias("bits"))
    whole = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r in rows.toLocalIterator():  # 2^(BITMAP_BITS-15) rows of 4 kB at most
        whole[r["k"] << 12 : (r["k"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return grams.sparkSession.sparkContext.broadcast(whole.tobytes())


def packed_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, did, tx, th, z): texts compressed, for the way through a shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for batch in common.slices(whole, size=4 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in TEXT), pa.array([press.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", *TEXT, "z"])

    return texts.mapInArrow(work, "doc_id long, did long, tx long, th long, z binary")


def unpacked(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def per_text(rows: DataFrame, fields: str) -> DataFrame:
    """Rows of a text gathered; they are never more than its windows."""
    return rows.groupBy(*TEXT).agg(F.collect_list(F.struct(*fields.split())).alias("found"))


def listed(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A column of lists of structs of numbers: where each row's list starts and ends, and the fields of all in a row. A null list is empty."""
    col = batch.column(column)
    sizes = pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    flat = col.flatten()
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), {x.name: flat.field(i).to_numpy(zero_copy_only=False) for i, x in enumerate(flat.type)}


def pieces(batch: pa.RecordBatch, column: str, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose lists hold about `most` values (one row at least)."""
    ends = np.cumsum(pa.compute.list_value_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False) + 1)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def removed_spans(rows: DataFrame) -> DataFrame:
    """(did, tx, th, spans) from rows (did, tx, th, a, b): overlapping and touching spans are one; spans lists starts and ends in turn."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "found"):
                bounds, cols = listed(batch, "found")
                row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
                at = np.lexsort((cols["a"], row))
                row, a, b = row[at], cols["a"][at], cols["b"][at]
                lift = row * (1 << 40)  # one number line, rows far apart
                reach = np.maximum.accumulate(b + lift)
                first = np.flatnonzero(np.concatenate([[True], (a + lift)[1:] > reach[:-1]]))
                last = np.concatenate([first[1:], [len(a)]]) - 1
                flat = np.stack([a[first], reach[last] - lift[last]], axis=1).ravel()
                offsets = np.concatenate([[0], np.cumsum(2 * np.bincount(row[first], minlength=batch.num_rows))])
                spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in TEXT), spans], names=[*TEXT, "spans"])

    return per_text(rows, "a b").mapInArrow(work, "did long, tx long, th long, spans array<bigint>")

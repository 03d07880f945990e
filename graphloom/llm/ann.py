"""Approximate nearest neighbours by shifted space-filling curves.

Nearness is the inner product. A vector gets one more component that brings all to
the same length, a query zero there; then the nearest by distance is the one with
the largest inner product. Each of several curves turns the vectors at random,
shifts and quantises the first few coordinates and numbers the cells along a Hilbert
curve. Spark range-partitions the vectors by that number, and a query is held
against the vectors up to `window` ranks before and behind it on every curve; the
best of all curves are merged by their exact inner products, summed component by
component, so that a score never depends on where it was computed.

How wide a window must be depends on the data, so it is fitted: for a bounded sample
of queries the true neighbours are found by brute force, and the window is the rank
distance within which the wanted share of them lies on at least one curve. Vectors
without structure need windows in proportion to their number; nothing is cut off.

Equal vectors are one vector in the index, with the smallest ids of its rows, as
many as any query could need. Vectors that are null, zero or hold null or non-finite
components take no part, nor do rows without an id; shorter vectors count as having
zeros at the end. Rows that share an id but not a vector are rows of their own: each is
a candidate, and each asks, so that such a query_id has its ranks once for each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import common

NEIGHBOURS = 20
#: Curves, coordinates of a curve and bits of each, and how far coordinates are told apart, in standard deviations.
CURVES, DIMS, BITS, SPREAD = 12, 8, 6, 3.0
#: Queries of the sample that fits the window, and the share of true neighbours that must lie in it.
SAMPLE, RECALL = 256, 0.95
#: Least and most ranks of a tile, between which it follows the window.
TILES = (64, 2048)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (rows of coordinates under 2^bits) along the Hilbert curve: undo excess turns from the top bit down, then Gray-decode and interleave."""
    x = cells.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        low = q - one
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0]) ^ swap
            x[i] = x[i] ^ swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        turn = np.where((x[-1] & q) != 0, turn ^ (q - one), turn)
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


class Curves:
    """Random turns and shifts, the same wherever they are made."""

    def __init__(self, mean: np.ndarray, second: np.ndarray, curves: int = CURVES):
        rng, dim = np.random.default_rng(97), len(mean)
        cov = second - np.outer(mean, mean)
        self.mean, self.maps = mean, []
        for _ in range(curves):
            turn = np.linalg.qr(rng.normal(size=(dim, max(dim, DIMS))))[0]
            turn = np.pad(turn, ((0, 0), (0, max(0, DIMS - turn.shape[1]))))[:, :DIMS]
            scale = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", turn, cov, turn), 1e-30))
            self.maps.append((turn / scale, rng.random(DIMS)))

    def keys(self, x: np.ndarray) -> Iterator[np.ndarray]:
        for turn, shift in self.maps:
            y = np.clip((x - self.mean) @ turn, -SPREAD, SPREAD) / (2 * SPREAD) + 0.5
            yield hilbert(((y + shift) / 2 * ((1 << BITS) - 1)).astype(np.int64), BITS).view(np.int64)


def matrix(packed: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f8").reshape(-1, dim)


def extended(x: np.ndarray, top: float, query: bool) -> np.ndarray:
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(top * top - np.einsum("ij,ij->i", x, x), 0))
    return np.c_[x, more]


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows, summed from the first component to the last."""
    out = np.empty(len(q))
    for at in range(0, len(q), 4096):
        out[at : at + 4096] = np.cumsum(q[at : at + 4096] * x[at : at + 4096], axis=1)[:, -1]
    return out


def best(queries: np.ndarray, points: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the rows of its k best points, -1 where there are fewer, and their scores: by exact score, ties to the smaller of `least`. A matrix product finds who is in the running; its error has a bound, and all within it stay in."""
    near = queries @ points.T
    slack = 4 * points.shape[1] * np.finfo(float).eps * np.linalg.norm(queries, axis=1) * np.linalg.norm(points, axis=1).max()
    if len(points) > k:
        bar = np.partition(near, len(points) - k, axis=1)[:, -k] - slack
    else:
        bar = np.full(len(queries), -np.inf)
    row, col = np.nonzero(near >= bar[:, None])
    s = exact(queries[row], points[col])
    at = np.lexsort((least[col], -s, row))
    row, s, col = row[at], s[at], col[at]
    first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(queries)))[:-1]])
    rank = np.arange(len(row)) - first[row]
    out, scores = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -np.inf)
    keep = rank < k
    out[row[keep], rank[keep]], scores[row[keep], rank[keep]] = col[keep], s[keep]
    return out, scores


def _packed_rows(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(vec_id, z): usable vectors as doubles in a row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e")).filter("vec_id IS NOT NULL")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, e in zip(batch.column("vec_id").to_pylist(), batch.column("e").to_pylist(), strict=True):
                if e and None not in e:
                    x = np.array(e + [0.0] * (dim - len(e)), "<f8") + 0.0
                    if np.isfinite(x).all() and x.any():
                        ids.append(i)
                        out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "z"])

    return rows.mapInArrow(work, "vec_id long, z binary")


def _moments(points: DataFrame, dim: int) -> tuple[float, np.ndarray, np.ndarray, int]:
    """Greatest length, then mean and second moments of the extended vectors; a few numbers from each partition."""

    def norms(batches):
        top = 0.0
        for batch in batches:
            x = matrix(batch.column("z").to_pylist(), dim)
            top = max([top, *np.sqrt(np.einsum("ij,ij->i", x, x))])
        yield pa.RecordBatch.from_arrays([pa.array([float(top)])], names=["top"])

    top = points.mapInArrow(norms, "top double").agg(F.max("top")).first()[0] or 0.0

    def sums(batches):
        n, one, two = 0, np.zeros(dim + 1), np.zeros((dim + 1, dim + 1))
        for batch in batches:
            x = extended(matrix(batch.column("z").to_pylist(), dim), top, False)
            n, one, two = n + len(x), one + x.sum(axis=0), two + x.T @ x
        whole = np.c_[two, one, np.full(dim + 1, float(n))]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int64()), pa.array([r.tobytes() for r in whole], pa.binary())], names=["i", "v"])

    def total(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column("i").to_pylist(), batch.column("v").to_pylist(), strict=True):
                found[i] = found.get(i, 0.0) + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["i", "v"])

    # summed by row of the matrix on the executors; the driver gets dim + 1 rows
    kind = "i long, v binary"
    rows = points.mapInArrow(sums, kind).repartition(min(dim + 1, common.partitions(points.sparkSession)), "i").mapInArrow(total, kind).collect()
    whole = np.stack([np.frombuffer(r["v"]) for r in sorted(rows, key=lambda r: r["i"])]) if rows else np.zeros((dim + 1, dim + 3))
    n = int(whole[0, -1])
    return top, whole[:, -2] / max(n, 1), whole[:, :-2] / max(n, 1), n


def _ranked(points: DataFrame, queries: DataFrame, dim: int, top: float, curves: Curves) -> DataFrame:
    """(curve, rank, key, least, query, z): points and queries in one order along each curve."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, is_query = matrix(batch.column("z").to_pylist(), dim), batch.column("query").to_numpy(zero_copy_only=False).astype(bool)
            y = np.where(is_query[:, None], extended(x, top, True), extended(x, top, False))
            for k, h in enumerate(curves.keys(y)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), pa.array(h), batch.column("key"), batch.column("least"), batch.column("query"), batch.column("z")], names=["curve", "h", "key", "least", "query", "z"])

    both = points.select("key", "least", "z", F.lit(0).alias("query")).unionByName(queries.select("key", "least", "z", F.lit(1).alias("query")))
    placed = both.mapInArrow(work, "curve int, h long, key long, least long, query int, z binary")
    order = ["curve", "h", "key", "query"]
    placed = placed.repartitionByRange(common.partitions(points.sparkSession), *order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id())
    placed = common.written(placed, "curves")
    part = F.shiftright("m", 33)
    pieces = sorted(tuple(r) for r in placed.groupBy("curve", part.alias("part")).agg(F.count("*").alias("n"), F.min("m").alias("least")).collect())  # a row for each partition and curve
    offsets, at, last = [], 0, None
    for curve, p, n, least in pieces:
        at = 0 if curve != last else at
        offsets.append((curve, p, at - least))
        at, last = at + n, curve
    table = points.sparkSession.createDataFrame(offsets or [(0, 0, 0)], "curve int, part long, shift long")
    return placed.withColumn("part", part).join(F.broadcast(table), ["curve", "part"]).select("curve", (F.col("m") + F.col("shift")).alias("rank"), "key", "least", "query", "z")


def _true(points: DataFrame, sample: list, dim: int, k: int) -> DataFrame:
    """(q, key): brute force for a bounded sample of queries."""
    sent = points.sparkSession.sparkContext.broadcast((np.array([r["key"] for r in sample]), b"".join(r["z"] for r in sample)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, blob = sent.value
        q = np.frombuffer(blob, "<f8").reshape(-1, dim)
        for batch in batches:
            if batch.num_rows:
                least, key = batch.column("least").to_numpy(), batch.column("key").to_numpy()
                i, s = best(q, matrix(batch.column("z").to_pylist(), dim), least, k)
                on = i.ravel() >= 0
                i = i.ravel()[on]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, k)[on]), pa.array(key[i]), pa.array(least[i]), pa.array(s.ravel()[on])], names=["q", "key", "least", "s"])

    found = points.mapInArrow(work, "q long, key long, least long, s double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "least", "key"))
    return found.withColumn("r", rank).filter(F.col("r") <= k).select("q", "key")


def _fitted_window(ranked: DataFrame, points: DataFrame, queries: DataFrame, dim: int, k: int, n: int, recall: float) -> int:
    sample = queries.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()
    if not sample:
        return 1
    pairs = F.broadcast(common.written(_true(points, sample, dim, k + 1), "true"))  # SAMPLE times k + 1 rows at most
    slim = ranked.select("curve", "rank", "key", "query")
    near = slim.filter("query = 0").join(pairs, "key").select("curve", F.col("rank").alias("there"), "q", "key")
    own = slim.filter("query = 1").select("curve", F.col("rank").alias("here"), F.col("key").alias("q")).join(F.broadcast(pairs.select("q").distinct()), "q")
    apart = near.join(own, ["curve", "q"]).filter("key <> q").groupBy("q", "key").agg(F.min(F.abs(F.col("here") - F.col("there"))).alias("d"))
    need = sorted(r["d"] for r in apart.collect())
    return max(64, int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))])) if need else n


def _tiles(ranked: DataFrame, window: int, dim: int, k: int) -> DataFrame:
    """(q, found): for each query and tile of each curve the best points, packed."""
    low, high = TILES
    size = min(max(window, low), high)
    reach = F.sequence(F.floor(F.greatest(F.col("rank") - window, F.lit(0)) / size), F.floor((F.col("rank") + window) / size))
    rows = ranked.withColumn("tile", F.explode(F.when(F.col("query") == 1, reach).otherwise(F.array(F.floor(F.col("rank") / size)))))
    rows = rows.select("curve", "tile", "query", "key", "least", "z")
    parts = common.partitions(ranked.sparkSession)
    dealt = rows.repartition(parts, "curve", "tile").sortWithinPartitions("curve", "tile", "query")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, points = None, []  # at most a tile's points are held; queries stream past them
        stacked = None
        for batch in batches:
            if not batch.num_rows:
                continue
            curve, t, query, key, least = (batch.column(c).to_numpy() for c in ("curve", "tile", "query", "key", "least"))
            x = matrix(batch.column("z").to_pylist(), dim)
            cuts = np.flatnonzero((curve[1:] != curve[:-1]) | (t[1:] != t[:-1]) | (query[1:] != query[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)]):
                if tile != (curve[a], t[a]):
                    tile, points, stacked = (curve[a], t[a]), [], None
                if not query[a]:
                    points.append((x[a:b], key[a:b], least[a:b]))
                    stacked = None
                elif points:
                    stacked = stacked or tuple(map(np.concatenate, zip(*points, strict=True)))
                    i, s = best(x[a:b], stacked[0], stacked[2], k)
                    packed = np.stack([np.where(i >= 0, stacked[1][i], -1), stacked[2][i], s.view(np.int64)], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array([r.tobytes() for r in packed], pa.binary())], names=["q", "found"])

    return dealt.mapInArrow(work, "q long, found binary")


def nearest(vectors: DataFrame, is_query, k: int = NEIGHBOURS, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which is_query (a condition on vec_id) holds, nearest first, ties to the smaller id."""
    dim = vectors.agg(F.max(F.size(vec_col))).first()[0] or 0
    dim = max(1, dim)
    rows = common.written(_packed_rows(vectors, id_col, vec_col, dim), "vectors")
    rank = F.row_number().over(Window.partitionBy("z").orderBy("vec_id"))
    grouped = rows.withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("z").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # numbered once, in a written table
    points = common.written(grouped.select("z", "ids", F.col("ids")[0].alias("least")).withColumn("key", F.monotonically_increasing_id()), "points")
    asked = common.written(rows.filter(is_query).join(points.select("z", "key"), "z").select("vec_id", "key"), "asked")
    queries = common.written(points.join(asked.select("key").distinct(), "key", "left_semi").select("key", "least", "z"), "queries")
    top, mean, second, n = _moments(points, dim)
    ranked = _ranked(points, queries, dim, top, Curves(mean, second))
    window = _fitted_window(ranked, points, queries, dim, k, n, recall)
    tiles = _tiles(ranked, window, dim, k + 1).groupBy("q").agg(F.collect_list("found").alias("found"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, i, s = [], [], []
            for key, found in zip(batch.column("q").to_pylist(), batch.column("found").to_pylist(), strict=True):
                keys, least, scores = (np.frombuffer(b"".join(found), np.int64).reshape(-1, 3, k + 1)[:, c].ravel() for c in range(3))
                keys, first = np.unique(keys, return_index=True)
                scores = np.where(keys < 0, -np.inf, scores[first].view(float))
                at = np.lexsort((keys, least[first], -scores))[: k + 1]
                at = at[keys[at] >= 0]
                q += [key] * len(at)
                i += keys[at].tolist()
                s += scores[at].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["q", "key", "score"])

    found = tiles.mapInArrow(merge, "q long, key long, score double")
    # equal vectors share a score: their rows are spread out again, the smallest ids first; the query's own row goes once
    spread = found.join(points.select("key", "ids"), "key").select("q", "score", "key", F.explode("ids").alias("vec_id"))
    listed = spread.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "key"))), 1, 4 * k + 4).alias("c"))
    hits = asked.join(listed, asked["key"] == listed["q"]).select(F.col("vec_id").alias("query_id"), "q", "c")
    own = F.array_position(F.transform("c", lambda x: (x["vec_id"] == F.col("query_id")) & (x["key"] == F.col("q"))), F.lit(True))
    hits = hits.withColumn("own", own).withColumn("c", F.when(F.col("own") > 0, F.concat(F.slice("c", 1, F.col("own").cast("int") - 1), F.slice("c", F.col("own").cast("int") + 1, 4 * k + 4))).otherwise(F.col("c")))
    return hits.select("query_id", F.posexplode(F.slice("c", 1, k)).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

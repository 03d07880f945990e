"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items are cut into overlapping passages. A passage is a
TF-IDF vector over the benchmark's own words, less those that many items share. A
randomised SVD of all the corpus's passages, in one distributed pass (a Gaussian
sketch of their second moments, closed on the driver by the Nystrom formula), gives
the latent space. Passages whose cosine there with an item's passage is high enough
are candidates. For a candidate the longest common subsequence of the item and the
passage with its surroundings decides: nearly all of the item's words in order is a
copy; a good part of them is a paraphrase if the item's answer (what follows an
answer mark, else its last sentence) is there too.

A benchmark is searched for in tiles of items with FEATURES distinct words together at
most (or one item), so that what the executors hold of it has a bound; every document is
searched against every tile.
Null and empty texts and items without words match nothing. An item all of whose
words are shared by many items is searched by all of its words. Repeated rows are
searched each. Items with one id and different texts are items of their own.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common, repeats

#: Words of half a passage; passages overlap by that much.
HALF = 16
#: Rank of the latent space and columns of the sketch beyond it; most distinct words of a tile of the benchmark.
RANK, MORE, FEATURES = 128, 32, 8192
#: A word that more than this share of the items have is no feature.
COMMON = 0.05
#: Least cosine of a candidate; least share of an item's words in order for a copy, and for a paraphrase with its answer.
COSINE, COPY, PARAPHRASE, ANSWER = 0.45, 0.75, 0.55, 0.7
#: Most bytes of the benchmark's words and passages.
BENCHMARK_MOST = 256 << 20
#: Features of a block of the sketch on its way through a shuffle.
BLOCK = 128
#: Bytes of text handled at once: few enough that their sums stay in a core's cache.
SLICE = 1 << 17
#: Passages and targets whose cosines are held at once.
PASSAGES, TARGETS = 4096, 1024

_KIND = repeats.Kind(True, 1, 1)
_BLANKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_ANSWER = re.compile(r"(?is).*\b(?:answer|solution|a)\s*[:=]\s*(.+)$")


def words(text: str) -> np.ndarray:
    """Hashes of the words: runs of letters and digits, lower-cased."""
    return repeats.units(_KIND, np.frombuffer(text.lower().encode().translate(_BLANKS), np.uint8))


def all_words(texts: list[str]) -> list[np.ndarray]:
    """words() of each text, hashed in one go."""
    raw = [t.lower().encode().translate(_BLANKS) for t in texts]
    buffer = np.frombuffer(b" ".join(raw), np.uint8)
    bounds = repeats.word_bounds(buffer)
    ends = np.cumsum([len(r) + 1 for r in raw])
    return np.split(repeats.units(_KIND, buffer, 0, bounds), np.searchsorted(bounds[0], ends[:-1]))


def answer_of(text: str) -> str:
    if m := _ANSWER.match(text):
        return m[1]
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    return parts[-1] if parts else ""


def common_words(item: list[int], other: list[int]) -> int:
    """Length of the longest common subsequence, in bits of whole numbers."""
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in other:
        u = v & at.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


class Reference:
    """The benchmark: items, their words and answers, and the features."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        self.items = [words(t) for _, t in rows]
        self.answers = [words(answer_of(t)) for _, t in rows]
        every, n = np.unique(np.concatenate([np.unique(w) for w in self.items] or [np.zeros(0, np.uint64)]), return_counts=True)
        rare = every[n <= max(1, COMMON * len(rows))]
        plain = [w for w in self.items if len(w) and not np.isin(w, rare).any()]
        self.vocabulary = np.union1d(rare, np.concatenate(plain)) if plain else rare
        self.size = max(1, len(self.vocabulary))
        self.may = np.zeros(1 << 16, bool)  # of a word's first bits, whether a feature has them
        self.may[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def features(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are features, and the features."""
        on = np.flatnonzero(self.may[(w >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, w[on]), self.size - 1)
        same = self.vocabulary[at] == w[on] if len(on) else np.zeros(0, bool)
        return on[same], at[same]

    def counts(self, w: np.ndarray) -> np.ndarray:
        """Features of each passage of a short text, counted."""
        places, features = self.features(w)
        b = np.zeros((max(1, -(-len(w) // HALF)) + 1, self.size), np.float32)
        np.add.at(b, (places // HALF, features), 1)
        return b[:-1] + b[1:] if len(b) <= 2 else (b[:-1] + b[1:])[:-1]


class Halves:
    """Words of several texts by halves of passages. Passage k of a text is half k and the next; its last half alone is one only in a text of one half."""

    def __init__(self, ref: Reference, held: list[np.ndarray]):
        sizes = np.array([len(w) for w in held])
        n = np.maximum(1, -(-sizes // HALF))  # halves of each text, and an empty one behind them
        self.first = np.concatenate([[0], np.cumsum(n + 1)])
        self.words = np.concatenate([[0], np.cumsum(sizes)])
        places, self.features = ref.features(np.concatenate(held))
        self.doc = np.searchsorted(self.words, places, "right") - 1
        self.half = self.first[self.doc] + (places - self.words[self.doc]) // HALF
        self.passages = np.maximum(1, n - 1)

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """Of rows[feature] over each half."""
        out = np.zeros((self.first[-1], rows.shape[1]), rows.dtype)
        if len(self.half):
            at = np.flatnonzero(np.concatenate([[True], self.half[1:] != self.half[:-1]]))
            out[self.half[at]] = np.add.reduceat(rows[self.features], at, axis=0)
        return out

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and first half of every passage."""
        of = np.repeat(np.arange(len(self.passages)), self.passages)
        behind = np.cumsum(self.passages) - self.passages
        return of, self.first[of] + np.arange(len(of)) - behind[of]


class Moments:
    """Second moments of passages: how often two features are in one passage, times omega. Counted pair by pair up to FEATURES features, else summed as rows of omega."""

    def __init__(self, size: int, omega: np.ndarray):
        self.size, self.omega = size, omega.astype(np.float32)
        self.pairs = np.zeros(size * size, np.float32) if size <= FEATURES else None
        self.rows = np.zeros(omega.shape)

    def add(self, halves: Halves) -> None:
        f, h = halves.features, halves.half
        if not len(f):
            return
        first = halves.first[:-1]
        if self.pairs is None:
            b = halves.sums(self.omega)
            near = b * 2  # the passages a half belongs to: with the one before and with the one behind
            near[1:] += b[:-1]
            near[:-1] += b[1:]
            near[first] -= b[first]  # the first half is in one only
            order = np.argsort(f, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], f[order][1:] != f[order][:-1]]))
            self.rows[f[order][at]] += np.add.reduceat(near[h[order]], at, axis=0)
            return
        weight = np.where(first[halves.doc] == h, 1, 2).astype(np.float32)
        np.add.at(self.pairs, f * self.size + f, weight / 2)  # pairs count for both of their features in total()
        i, step = np.arange(len(f) - 1), 1
        while len(i):
            i = i[h[i + step] - h[i] <= 1]
            j = i + step
            np.add.at(self.pairs, f[i] * self.size + f[j], np.where(h[i] == h[j], weight[i], np.float32(1)))
            step += 1
            i = i[i + step < len(f)]

    def total(self) -> np.ndarray:
        if self.pairs is not None:
            m = self.pairs.reshape(self.size, self.size)
            self.rows += m @ self.omega
            self.rows += m.T @ self.omega
        return self.rows


def _sketch(texts: DataFrame, sent, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Second moments of all passages times omega, document frequencies of the features, and the number of documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref: Reference = pickle.loads(sent.value)
        moments, df, n = Moments(ref.size, omega), np.zeros(ref.size), 0
        for whole in batches:
            for batch in common.slices(whole, size=SLICE):
                n += batch.num_rows
                halves = Halves(ref, all_words(batch.column("text").to_pylist()))
                moments.add(halves)
                df += np.bincount(np.unique(halves.doc * ref.size + halves.features) % ref.size, minlength=ref.size)
        y = moments.total()
        starts = list(range(0, ref.size, BLOCK))
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([np.c_[y, df][a : a + BLOCK].tobytes() for a in starts], pa.binary()), pa.array([n if a == 0 else 0 for a in starts], pa.int64())], names=["at", "y", "n"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for at, y, n in zip(batch.column("at").to_pylist(), batch.column("y").to_pylist(), batch.column("n").to_pylist(), strict=True):
                x = sums.setdefault(at, [0.0, 0])
                x[0], x[1] = x[0] + np.frombuffer(y), x[1] + n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x[0].tobytes() for x in sums.values()], pa.binary()), pa.array([x[1] for x in sums.values()], pa.int64())], names=["at", "y", "n"])

    ref: Reference = pickle.loads(sent.value)
    out, n = np.zeros((ref.size, omega.shape[1] + 1)), 0
    parts = texts.select("text").mapInArrow(work, "at long, y binary, n long").repartition(common.partitions(texts.sparkSession), "at")
    for r in parts.mapInArrow(total, "at long, y binary, n long").toLocalIterator():  # FEATURES rows of the sketch at most
        out[r["at"] : r["at"] + BLOCK] += np.frombuffer(r["y"]).reshape(-1, omega.shape[1] + 1)
        n += r["n"]
    return out[:, :-1], out[:, -1], n


def _latent(ref: Reference, y: np.ndarray, omega: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows for each feature: its weight in each latent direction. The items' own passages have part in the moments."""
    own = np.zeros_like(y)
    for w in ref.items:
        x = ref.counts(w)
        own += x.T @ (x @ omega)
    scale = max(1.0, np.linalg.norm(y) / max(np.linalg.norm(own), 1e-9))
    y = (y + scale * own) * idf[:, None]  # moments of the weighted vectors, times omega over idf
    inner = (omega / idf[:, None]).T @ y
    shift = 1e-8 * np.trace(inner) + 1e-9
    values, vectors = np.linalg.eigh((inner + inner.T) / 2 + shift * np.eye(len(inner)))
    root = y @ (vectors / np.sqrt(np.maximum(values, shift)))
    left = np.linalg.svd(root, full_matrices=False)[0][:, :RANK]
    return (left * idf[:, None]).astype(np.float32)


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, share (of the item's words found in order), cosine, answered, start (in words of the document): a row for every document and benchmark item that it contains."""
    texts = common.keyed(docs, id_col, text_col)
    parts = [_search(texts, tile) for tile in _models(texts, benchmark, item_col, item_text)]
    if not parts:
        return texts.select("doc_id").limit(0).selectExpr("doc_id", "0L AS item_id", "0D AS share", "0D AS cosine", "false AS answered", "0L AS start")
    return functools.reduce(DataFrame.unionByName, parts)


def _models(texts: DataFrame, benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[tuple]:
    """For each tile of the benchmark what finds it, as two broadcasts; their number is that of the tiles."""
    rows = [(r[0], r[1]) for r in benchmark.select(F.col(item_col).cast("long"), F.coalesce(F.col(item_text), F.lit(""))).distinct().toLocalIterator()]
    for tile in _tiles([(i, t) for i, t in sorted(rows, key=lambda x: (x[0] is None, x)) if re.search(r"\w", t)]):
        yield _model(texts, Reference(tile))


def _tiles(rows: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Runs of items with FEATURES distinct words together at most, or of one item."""
    tile: list[tuple[int, str]] = []
    seen: set[int] = set()
    for row in rows:
        own = set(words(row[1]).tolist())
        if tile and len(seen | own) > FEATURES:
            yield tile
            tile, seen = [], set()
        tile.append(row)
        seen |= own
    if tile:
        yield tile


def _model(texts: DataFrame, ref: Reference) -> tuple:
    spark = texts.sparkSession
    sent = common.bounded(spark, pickle.dumps(ref), BENCHMARK_MOST)
    omega = np.random.default_rng(31).normal(size=(ref.size, RANK + MORE))
    y, df, n = _sketch(texts, sent, omega)
    idf = np.log((n + 1) / (df + 1)) + 1
    latent = _latent(ref, y, omega, idf)
    halves = Halves(ref, ref.items)
    of, at = halves.starts()
    z = halves.sums(latent)
    z = z[at] + z[at + 1]
    targets = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    return sent, common.bounded(spark, pickle.dumps((latent, of, targets)), BENCHMARK_MOST)


class Searcher:
    """Made from what _model() sends."""

    def __init__(self, sent, model):
        self.ref: Reference = pickle.loads(sent.value)
        self.latent, self.of, self.targets = pickle.loads(model.value)
        self.items, self.answers = [w.tolist() for w in self.ref.items], [w.tolist() for w in self.ref.answers]

    def __call__(self, texts: list[str]) -> dict[tuple[int, int], tuple]:
        """(text, item) -> (share, cosine, answered, start) of what the texts hold."""
        held = all_words(texts)
        halves = Halves(self.ref, held)
        sums = halves.sums(self.latent)
        doc, at = halves.starts()
        behind = np.cumsum(halves.passages) - halves.passages
        hits: dict[tuple[int, int], tuple] = {}
        for a in range(0, len(at), PASSAGES):
            z = sums[at[a : a + PASSAGES]] + sums[at[a : a + PASSAGES] + 1]
            norm = np.linalg.norm(z, axis=1)
            some = np.flatnonzero(norm > 1e-9)
            z = z[some] / norm[some, None]
            for b in range(0, len(self.targets), TARGETS):
                cos = z @ self.targets[b : b + TARGETS].T
                for r, t in zip(*np.nonzero(cos >= COSINE), strict=True):
                    p, k = a + int(some[r]), int(self.of[b + t])
                    d = int(doc[p])
                    verdict = _verified(held[d], p - int(behind[d]), self.items[k], self.answers[k])
                    if verdict and (old := hits.get((d, k), (0,)))[0] <= verdict[0]:
                        hits[d, k] = (verdict[0], max(float(cos[r, t]), old[1] if len(old) > 1 else 0.0), *verdict[1:])
        return hits


def _search(texts: DataFrame, model: tuple) -> DataFrame:
    """search() for one tile of the benchmark."""
    schema = "doc_id long, item_id long, share double, cosine double, answered boolean, start long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*model)
        for whole in batches:
            for batch in common.slices(whole, size=SLICE):
                ids = batch.column("doc_id").to_pylist()
                found = [(ids[d], searcher.ref.ids[k], *h) for (d, k), h in searcher(batch.column("text").to_pylist()).items()]
                cols = list(zip(*found, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return texts.mapInArrow(work, schema)


def _verified(doc: np.ndarray, passage: int, item: list[int], answer: list[int]) -> tuple[float, bool, int] | None:
    """(share, answered, start) if the passage with its surroundings holds the item. Items shorter than four words must be there whole."""
    around = len(item)
    start = max(0, passage * HALF - around)
    near = doc[start : (passage + 2) * HALF + around].tolist()
    there = set(near)
    if sum(map(there.__contains__, item)) < PARAPHRASE * len(item):  # more words in order than words there can't be
        return None
    # surroundings as wide as the item on both sides; the best stretch not much longer than the item counts
    share = common_words(item, near) / len(item)
    if share < PARAPHRASE or (len(item) < 4 and share < 1):
        return None
    width = len(item) + max(4, len(item) // 2)
    best = (0.0, 0)
    for a in range(0, max(1, len(near) - width + 1), max(1, len(item) // 8)):
        best = max(best, (common_words(item, near[a : a + width]) / len(item), -a))
    best = max(best, (common_words(item, near[-width:]) / len(item), -max(0, len(near) - width)))
    share, at = best[0], -best[1]
    answered = bool(answer) and common_words(answer, near[at : at + width]) >= ANSWER * len(answer)
    if share >= COPY or (share >= PARAPHRASE and answered):
        return share, answered, start + at
    return None


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no benchmark item; same columns. Every row is judged by its own text, whatever its id, and filtered where it is read: no shuffle."""
    texts = common.keyed(docs)
    for model in list(_models(texts, benchmark, "item_id", "text")):

        def work(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(*model)
            for whole in batches:
                for batch in common.slices(whole, size=SLICE):
                    hit = {d for d, _ in searcher([t or "" for t in batch.column("text").to_pylist()])}
                    yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(work, docs.schema)
    return docs

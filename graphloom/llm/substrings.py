"""Substring dedup by level-wise doubling.

Windows of words that repeat at one length alone are extended to twice that length,
and so on to the full length. At the first length places are sampled by content (see
repeats.py), so that every full window is represented whatever its text; where a
place's whole neighbourhood also repeats, that settles all of its windows at once.

A word goes if a window that covers it also starts in a document with a smaller
doc_id. Null and empty texts have no words. A null doc_id counts as before all
others; rows of one doc_id never remove one another's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common, repeats

WINDOW, FIRST = 13, 4


def _windows(need: DataFrame, texts: DataFrame, kind: repeats.Kind, lengths: list[int]) -> DataFrame:
    """(did, tx, th, s, and for each length two hashes) of the windows of the given segments."""
    joined = repeats.per_text(need, "p near far").join(repeats.packed_texts(texts), repeats.TEXT)
    schema = "did long, tx long, th long, s long, " + ", ".join(f"x{n} long, y{n} long" for n in lengths)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for whole in batches:
            for batch in repeats.pieces(whole, "found", 20_000):
                bounds, found = repeats.listed(batch, "found")
                own = [batch.column(c).to_numpy() for c in repeats.TEXT]
                made: list[list[np.ndarray]] = [[] for _ in names]
                for i, z in enumerate(batch.column("z")):
                    raw = np.frombuffer(repeats.unpacked(z.as_py()), np.uint8)
                    p, near, far = (found[k][bounds[i] : bounds[i + 1]] for k in ("p", "near", "far"))
                    s = np.unique(np.repeat(p - far, far - near + 1) + _counting(far - near + 1))
                    cols = [*(np.full(len(s), x[i]) for x in own), s]
                    both = [repeats.units(kind, raw, k) for k in (0, 1)]
                    for n in lengths:
                        for k in (0, 1):
                            cols.append(np.concatenate([repeats.Hashes(both[k][a : b + n], k)(t - a, t - a + n) for a, b, t in _runs(s)]).view(np.int64))
                    for kept, x in zip(made, cols, strict=True):
                        kept.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in made], names=names)

    return joined.mapInArrow(work, schema)


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size in turn."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _runs(s: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Sorted starts by stretches of bounded width."""
    i = 0
    while i < len(s):
        j = int(np.searchsorted(s, s[i] + repeats.STEP))
        yield int(s[i]), int(s[j - 1]), s[i:j]
        i = j


def repeated_windows(docs: DataFrame, length: int = WINDOW, first: int = FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (from and to in words, flat) and kept (words left, joined by a blank, as bytes) for every row."""
    kind = repeats.Kind(True, length, first)
    texts = repeats.corpus(docs, id_col, text_col)
    every = repeats.segment_table(texts, kind)
    again = common.written(every.groupBy("v").agg(F.min("did").alias("lo"), F.max("did").alias("hi")).filter("lo < hi").select("v"), "grams")
    segs = repeats.segment_table(texts, kind, repeats.bitmap_of(again))
    rep = common.written(segs.join(again, "v"), "segments")
    same = rep.groupBy("v", "c").agg(F.min("did").alias("m"))
    several = same.groupBy("v").agg(F.count("*").alias("contents"))
    judged = common.written(rep.join(same.join(several, "v"), ["v", "c"]).selectExpr("did", "tx", "m", "contents", *(f"{x} AS {k}" for k, x in repeats.FIELDS.items())), "judged")
    spans = judged.filter("did > m").select(*repeats.TEXT, (F.col("p") - F.col("far")).alias("a"), (F.col("p") - F.col("near") + length).alias("b"))
    lengths = [n for n in (first << k for k in range(1, 20)) if n < length] + [length]
    left = _windows(judged.filter("did = m AND contents > 1").select(*repeats.TEXT, "p", "near", "far"), texts, kind, lengths)
    for k, n in enumerate(lengths):
        names = [f"x{n}", f"y{n}"]
        left = common.written(left, f"level-{n}")
        least = left.groupBy(*names).agg(F.min("did").alias("lo"), F.max("did").alias("hi")).filter("lo < hi")
        left = left.join(least, names).drop("hi", *names)
        left = left.drop("lo") if k < len(lengths) - 1 else left.filter("did > lo")
    spans = spans.unionByName(left.select(*repeats.TEXT, F.col("s").alias("a"), (F.col("s") + length).alias("b")))
    joined = repeats.packed_texts(texts).join(repeats.removed_spans(spans), repeats.TEXT, "left").select("doc_id", "z", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "z", 1 << 20):
                out: list[list] = [[], [], []]
                for z, spans in zip(batch.column("z"), batch.column("spans"), strict=True):
                    words, flat, kept, at = repeats.unpacked(z.as_py()).split(), spans.as_py() or [], [], 0
                    for a, b in zip(flat[::2], flat[1::2], strict=True):
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                    for x, y in zip(out, (len(words), len(words) - len(kept), b" ".join(kept)), strict=True):
                        x.append(y)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), batch.column("spans"), pa.array(out[2], pa.binary())], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, spans array<bigint>, kept binary")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_windows(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS s, w FROM split WHERE len(w) >= 13
), windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS x FROM starts
), least AS (SELECT x, min(doc_id) AS d FROM windows GROUP BY x),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM windows JOIN least USING (x) WHERE doc_id > d
), gone AS (SELECT doc_id, list(i) AS nos, count(*) AS n FROM covered GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(nos, i)), ' ') END) AS kept_sha256
FROM split LEFT JOIN gone USING (doc_id)
"""

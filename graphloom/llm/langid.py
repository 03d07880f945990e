"""Language ID by error-correcting output codes.

Every language gets a codeword of +1 and -1. For each place of the codeword a
binary n-gram classifier tells the languages with +1 there from those with -1; a
text's language is the codeword with the least loss over all places, each place
weighted by how well its classifier did on the rows it learnt from. A text whose
best two codewords are about equally near is flagged as ambiguous.

Repeated rows are judged each; a very long text is read in chunks of CHUNK bytes, its
counts summed. Null texts and texts without a letter are `und` with score 0. One learnt language
gives that language everywhere; none gives `und` everywhere.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

#: n-gram lengths in bytes of the lower-cased text, and the number of hash buckets.
GRAMS, BITS = (2, 3, 4), 15
#: Labelled rows learnt from, of each language at most about so many (a bounded sample, chosen by a hash of doc_id).
SAMPLE = 1500
#: Most languages, so that counts and weights stay bounded.
LANGUAGES_MOST = 512
#: The best codeword must be ahead by so much of the probability, else the text is ambiguous.
MARGIN = 0.05
#: Bytes of text handled at once.
CHUNK = 1 << 19
UNKNOWN = "und"

_MULT = {2: np.uint32(0x9E3779B1), 3: np.uint32(0x85EBCA6B), 4: np.uint32(0xC2B2AE35)}
_LETTER = regex.compile(r"\p{L}")
#: ASCII other than letters becomes a blank.
_BLANKS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _hashed(buf: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of the n-gram at each place of a buffer, for each length; the last places see zeros."""
    x = np.concatenate([buf, np.zeros(4, np.uint8)]).astype(np.uint32)
    m = len(buf)
    code = x[:m].copy()
    for n in range(2, max(GRAMS) + 1):
        code = (code << np.uint32(8)) | x[n - 1 : n - 1 + m]
        if n in GRAMS:
            yield (code * _MULT[n]) >> np.uint32(32 - BITS)


def _prepared(text: str) -> bytes:
    return b" " + text.lower().encode().translate(_BLANKS) + b" "


def _sums(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its n-grams' rows of weights, and their number. No n-gram crosses two texts."""
    sums, counts = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    for i, text in enumerate(texts):
        whole = np.frombuffer(_prepared(text), np.uint8)
        for at in range(0, len(whole), CHUNK):
            part = whole[at : at + CHUNK + max(GRAMS) - 1]
            for n, h in zip(GRAMS, _hashed(part), strict=True):
                h = h[: max(0, min(CHUNK, len(part) - n + 1))]
                if len(h) > 4096:
                    sums[i] += np.bincount(h, minlength=1 << BITS) @ weights
                else:
                    sums[i] += weights[h].sum(axis=0)
                counts[i] += len(h)
    return sums, counts


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords: all splits of the languages in two for up to five, else random ones kept far apart."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        splits = [[1 if (s >> i) & 1 or i == n - 1 else -1 for i in range(n)] for s in range(2 ** (n - 1) - 1)]
        return np.array(splits, np.int8).T
    width, rng, best = 2 * int(np.ceil(np.log2(n))) + 9, np.random.default_rng(seed), None
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        far = min((code[i] != code[i + 1 :]).sum(axis=1).min() for i in range(n - 1))
        if not (np.abs(code.sum(axis=0)) == n).any() and (best is None or far > best[0]):
            best = far, code
    return best[1]


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> bytes:
    """A model from labelled rows, as bytes. Rows with null text, lang or id teach nothing."""
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).na.drop()
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES_MOST + 1).collect()}
    if len(totals) > LANGUAGES_MOST:
        raise ValueError(f"over {LANGUAGES_MOST} languages")
    langs = sorted(totals)
    if not langs:
        return _packed([], np.zeros((0, 1)), np.zeros((1 << BITS, 1)), np.zeros(1), np.zeros(1))
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample / totals[k])))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    index = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                total = seen.setdefault(index[lang], np.zeros(1 << BITS))
                one, n = np.zeros(1 << BITS), 0
                whole = np.frombuffer(_prepared(text), np.uint8)
                for k, h in zip(GRAMS, _hashed(whole), strict=True):
                    h = h[: max(0, len(whole) - k + 1)]
                    one += np.bincount(h, minlength=1 << BITS)
                    n += len(h)
                total += one / max(n, 1)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([v.astype("<f8").tobytes() for v in seen.values()], pa.binary())], names=["k", "v"])

    chosen = rows.filter(draw < share[F.col("lang")]).repartition(6, "doc_id")
    freq = np.zeros((len(langs), 1 << BITS))
    for r in chosen.mapInArrow(count, "k int, v binary").toLocalIterator():
        freq[r["k"]] += np.frombuffer(r["v"], "<f8")
    freq = freq / np.maximum(freq.sum(axis=1, keepdims=True), 1e-9) + 1e-6
    freq /= freq.sum(axis=1, keepdims=True)
    code = codewords(len(langs))
    weights = np.zeros((1 << BITS, code.shape[1]))
    for b in range(code.shape[1]) if len(langs) > 1 else []:
        weights[:, b] = np.log(freq[code[:, b] > 0].mean(axis=0)) - np.log(freq[code[:, b] < 0].mean(axis=0))
    expected = freq @ weights  # of each language and place
    right = np.minimum(expected * code, 10)
    scale = 4.0 / np.maximum(np.abs(expected).mean(axis=0), 1e-9)
    trust = np.clip(right.min(axis=0) * scale, 0.05, None)  # a place counts by how clearly it tells its hardest language
    return _packed(langs, code, weights, scale, trust / trust.sum())


def _packed(langs, code, weights, scale, trust) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, langs=np.array(langs, dtype=np.str_), code=code, weights=weights.astype(np.float32), scale=scale, trust=trust)
    return out.getvalue()


class Decoder:
    def __init__(self, blob: bytes):
        m = np.load(io.BytesIO(blob))
        self.langs, self.code, self.weights, self.scale, self.trust = m["langs"].tolist(), m["code"].astype(float), m["weights"].astype(np.float64), m["scale"], m["trust"]

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[bool]]:
        """Language, score and ambiguity of each text."""
        known = [t is not None and _LETTER.search(t) is not None for t in texts]
        pred, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), [False] * len(texts)
        if self.langs and any(known):
            rows = [i for i, k in enumerate(known) if k]
            sums, n = _sums([texts[i] for i in rows], self.weights)
            margin = sums / np.maximum(n, 1)[:, None] * self.scale
            loss = (np.logaddexp(0, -margin[:, None, :] * self.code[None]) * self.trust).sum(axis=2)
            p = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * len(self.trust))
            p /= p.sum(axis=1, keepdims=True)
            order = np.sort(p, axis=1)
            for i, best, top in zip(rows, p.argmax(axis=1), order, strict=True):
                pred[i], score[i] = self.langs[best], min(1.0, float(top[-1]))
                unsure[i] = len(top) > 1 and bool(top[-1] - top[-2] < MARGIN)
        return pred, score, unsure


def predict(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row. The weights sent out are bounded by 2^BITS rows and LANGUAGES_MOST."""
    sent = common.bounded(docs.sparkSession, model, 64 << 20)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(sent.value)
        for whole in batches:
            for batch in common.slices(whole):
                pred, score, unsure = decode(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(unsure, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out(col):
    return F.coalesce(common.crc_mod(col, 4) == 2, F.lit(False))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    found = predict(docs, fit(docs.filter(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents that the language classifier does not reject: those with a letter whose language isn't in doubt between two codewords. Same columns. Every row is judged by its own text, in one pass without a shuffle; rows with a null text go, whatever their id."""
    sent = common.bounded(docs.sparkSession, fit(docs.filter(~held_out(F.col("doc_id")))), 64 << 20)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(sent.value)
        for whole in batches:
            for batch in common.slices(whole):
                pred, _, unsure = decode(batch.column("text").to_pylist())
                yield batch.filter(pa.array([p != UNKNOWN and not u for p, u in zip(pred, unsure, strict=True)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)

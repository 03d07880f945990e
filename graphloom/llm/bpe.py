"""Byte-level BPE by monoid tree reduction.

A piece of text is encoded by halves: each half on its own, then the two token
lists are joined by re-encoding a window around the seam. The window grows until
its outermost tokens are the ones that stood there before. They were neighbours of
the tokens outside in an encoding, and a token list is the encoding of its bytes
exactly when every neighbouring pair is, so nothing outside can change. Lists under
this join are a monoid; decoding is the concatenation of bytes up the same tree.

Null and empty texts have no tokens and decode to nothing. Rows repeat as they come.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

#: Pieces of so many bytes are merged directly; longer ones are halved.
LEAF = 24
#: Distinct pieces that a worker remembers before it starts anew.
REMEMBERED = 400_000
#: Most bytes of a rank file.
RANKS_MOST = 64 << 20


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 bytes and a number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line)}


class TreeEncoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}

    def merge(self, raw: bytes) -> list[int]:
        """The merges as they are defined: always the pair of lowest rank, leftmost first."""
        n = len(raw)
        if n > 4 * LEAF:
            return self._merge_heap(raw)
        ranks = self.ranks
        parts = [raw[i : i + 1] for i in range(n)]
        get = ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_heap(self, raw: bytes) -> list[int]:
        """The same merges in n log n steps, for the wide windows that repetitive texts need."""
        n, get = len(raw), self.ranks.get
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if end[i] < 0 or j >= n or end[j] != stop:
                continue
            end[i], after[i], end[j] = stop, after[j], -1
            if after[i] < n:
                before[after[i]] = i
                if (r := get(raw[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := get(raw[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = after[i]
        return out

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two encodings' bytes in a row."""
        if not a or not b:
            return a or b
        i = j = 1
        while True:
            left, right = a[-i:], b[:j]
            window = self.merge(b"".join([self.tokens[t] for t in left + right]))
            left_stable = i >= len(a) or window[0] == left[0]
            right_stable = j >= len(b) or window[-1] == right[-1]
            if left_stable and right_stable:
                return a[: len(a) - i] + window + b[j:]
            i, j = (i if left_stable else min(2 * i, len(a))), (j if right_stable else min(2 * j, len(b)))

    def reduce(self, raw: bytes) -> list[int]:
        if len(raw) <= LEAF:
            return self.merge(raw)
        half = len(raw) // 2
        return self.join(self.reduce(raw[:half]), self.reduce(raw[half:]))

    def piece(self, raw: bytes) -> list[int]:
        """A match of the split pattern; one that is itself a token is that token."""
        return [r] if (r := self.ranks.get(raw)) is not None else self.reduce(raw)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class _Pieces(dict):
    """Piece -> its ids as little-endian 32-bit integers."""

    def __init__(self, encoder: TreeEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        raw = piece.encode()
        ids = np.array(self.encoder.piece(raw), "<u4").tobytes()
        if len(raw) <= 64:
            self[piece] = ids
        return ids


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers in a row), decoded (bytes of the ids decoded again). One pass, no shuffle.

    The driver reads the rank file and sends it to the executors, under a bound of RANKS_MOST bytes.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        sent = common.bounded(spark, f.read(), RANKS_MOST)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TreeEncoder(parse_ranks(sent.value))
        find, pieces = regex.compile(pattern).findall, _Pieces(encoder)
        for whole in batches:
            for batch in common.slices(whole, size=2 << 20):
                n, ids, back = [], [], []
                for text in batch.column("text").to_pylist():
                    packed = b"".join(map(pieces.__getitem__, find(text)))
                    ids.append(packed)
                    n.append(len(packed) // 4)
                    back.append(encoder.decode(np.frombuffer(packed, "<u4").tolist()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return common.keyed(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode_decode(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))

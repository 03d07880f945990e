"""The pipeline's near copies take their candidates by fingerprints within three bits, as op7 joins them."""

import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import near, simhash


def test_candidates_share_the_component_of_their_fingerprints(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(4000)}" for _ in range(3000)]
    texts = [" ".join(base), " ".join([*base, "x"]), " ".join(["y", *base]), " ".join(rng.sample(base, 3000)), "a b", ""]
    prints = [simhash.fingerprint(t, near.WORDS) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert root[:3] == [0, 0, 0] and len(set(root)) == 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    distinct = near._signed(docs, "doc_id", "text").groupBy("key").agg(F.min("doc_id").alias("least"), F.min("bands").alias("bands"), F.min("fp").alias("fp"))
    values = {r.least: np.frombuffer(r.bands, np.int64) for r in near.joined_prints(distinct).collect()}
    assert all(len(v) == near.BANDS + 1 for v in values.values())
    assert all((values[i][-1] == values[j][-1]) == (root[i] == root[j]) for i in values for j in values)

"""The training-data operators against brute force, exact round trips and held-out accuracy, with odd inputs: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import ann, bpe, components, decontaminate, langid, licenses, lines, registry, repeats, simhash, substrings, suffixes, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
KIND = "doc_id long, text string, lang string, source string, n_chars long, spans string, lid long, kept string, score string, v long"


def words(rng, n, size=60):
    return " ".join(f"w{int(size * rng.random() ** 2)}x" for _ in range(n))


def odd_documents(spark, rng=None):
    """Rows with everything that may go wrong."""
    rng = rng or random.Random(1)
    base, line = words(rng, 120), words(rng, 20)
    texts = [None, "", " ", "\n\n", "one", "one two", base, base, base.replace("w1x", "w2x", 1), base + " more", "Tab\there\x0bthere " + base, line + "\n" + line, line + "\nother words here now\n" + line + " tail", words(rng, 300), "é ü ñ 😀 " * 30, "a" * 3000, "ab" * 900, words(rng, 30000, 5000), words(rng, 50) + " " + base[:260], base[100:460] + words(rng, 40)]
    rows = [(i, t, "en" if i % 2 else None, "s", None, "x", 1, "y", "z", 2) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, KIND)


def empty(spark):
    return spark.createDataFrame([], KIND)


# 2: byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    return P, bpe.TreeEncoder(ranks), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=120), st.text(alphabet="aeino ", max_size=400), st.text(alphabet="ab", min_size=100, max_size=900), st.text(alphabet="=-_", max_size=300)))
def test_bpe_is_what_the_library_gives(tiktoken_encoding, text):
    import regex

    P, encoder, library = tiktoken_encoding
    ids = [i for m in regex.findall(P.PATTERN, text) for i in encoder.piece(m.encode())]
    assert ids == library.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


def test_bpe_over_a_table(spark, tiktoken_encoding):
    P, _, library = tiktoken_encoding
    docs = odd_documents(spark)
    got = bpe.digests(bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)).collect()
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_decode(empty(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


# 3: suffix-array dedup


def brute_bytes(rows):
    count = Counter(b[i : i + 200] for _, b in rows for i in range(len(b) - 199))
    out = []
    for doc_id, b in rows:
        cover = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                cover[i : i + 200] = b"\1" * 200
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out.append((doc_id, len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [4096, 3])
def test_suffixes(spark, monkeypatch, block):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    docs = odd_documents(spark)
    got = suffixes.repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect()), key=str) == brute_bytes([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])


def test_suffixes_of_nothing(spark):
    assert suffixes.repeated_bytes(empty(spark)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=48).map(lambda b: bytes(x % 3 + 97 for x in b).ljust(64, b"a")), min_size=1, max_size=30))
def test_deep_shallow_order(texts):
    numbers = [int.from_bytes(t) for t in texts]
    order, shared = suffixes.deep_shallow(texts, numbers, list(range(len(texts))), 64)
    assert [texts[i] for i in order] == sorted(texts)
    for a, b, n in zip(order, order[1:], shared[1:]):
        assert texts[a][:n] == texts[b][:n] and (n == 64 or texts[a][n] != texts[b][n])


def test_segments_cover_every_window_alike():
    kind = repeats.Kind(False, 200, 32)
    raw = np.frombuffer(words(random.Random(3), 400).encode(), np.uint8)
    u = repeats.units(kind, raw)
    (v, p, near, far, c), = repeats.segments(kind, u)
    starts = sorted(int(s) for a, n, f in zip(p, near, far, strict=True) for s in range(a - f, a - n + 1))
    assert starts == list(range(len(raw) - 199))
    (v2, *_), = repeats.segments(kind, repeats.units(kind, np.concatenate([raw[:50], raw])))
    assert set(v.tolist()) <= set(v2.tolist())


# 5: substring dedup


def brute_windows(rows):
    lowest = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    key = lambda d: -(1 << 63) if d is None else d
    for d, w in split:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            lowest[k] = min(lowest.get(k, key(d)), key(d))
    out = []
    for d, w in split:
        cover = [False] * len(w)
        for i in range(len(w) - 12):
            if lowest[tuple(w[i : i + 13])] < key(d):
                cover[i : i + 13] = [True] * 13
        kept = b" ".join(x for x, c in zip(w, cover, strict=True) if not c)
        out.append((d, len(w), sum(cover), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substrings(spark):
    docs = odd_documents(spark)
    got = substrings.repeated_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect()), key=str) == brute_windows([(r.doc_id, r.text) for r in docs.collect()])
    assert substrings.repeated_windows(empty(spark)).count() == 0


def test_rows_without_an_id_and_rows_that_share_one(spark):
    rng = random.Random(21)
    base = words(rng, 400, 900).split()
    rows = []
    for i in range(1000):
        at = rng.randrange(370)
        rows.append((rng.choice([None, None, 3, 4, i]), " ".join(base[at : at + rng.choice([2, 10, 14, 30])] + [f"own{i}"] * rng.randrange(3))))
    docs = spark.createDataFrame(rows + rows[:40], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = substrings.repeated_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect()), key=str) == brute_windows(rows)
    got = suffixes.repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect()), key=str) == brute_bytes([(d, t.encode()) for d, t in rows])


# 6: line dedup


def brute_lines(rows, order=None):
    key = lambda d: -(1 << 63) if d is None else d
    import re

    place = lambda d, t: (key(d), *(order(t) if order else ()))
    every = [(place(d, t), no, frozenset(w for w in re.split(r"[ \t\x0b\f\r]+", x) if w)) for d, t in rows for no, x in enumerate((t or "").split("\n"))]
    gone = set()
    for d, no, s in every:
        if s and any((e, m) < (d, no) and len(s & o) >= 0.8 * len(s | o) for e, m, o in every if o):
            gone.add((d, no))
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        kept = [x for i, x in enumerate(parts) if (place(d, t), i) not in gone]
        out.append((d, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines(spark):
    rng = random.Random(7)
    base = [words(rng, n, 40) for n in (3, 4, 5, 6, 9, 12, 20, 40, 70, 150)]
    rows = []
    for d in range(24):
        picked = []
        for _ in range(5):
            w = rng.choice(base).split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(50)}"
            picked.append(" ".join(w))
        rows.append((d, "\n".join(picked)))
    rows += [(50, None), (51, ""), (None, base[5]), (52, "\t \n" + base[4] + "\r"), (53, "\n".join([base[6]] * 40))]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, lines string, lid long")
    got = sorted(map(tuple, lines.dedup_lines(docs).collect()), key=str)
    assert got == brute_lines(rows)
    assert lines.dedup_lines(empty(spark)).count() == 0
    assert lines.without_repeated_lines(docs).columns == docs.columns


def test_lines_of_repeated_and_null_ids(spark):
    rng = random.Random(8)
    base = words(rng, 25, 400).split()
    rows = [(rng.choice([None, 1, 2, 3]), "\n".join(" ".join(base[:k] + [f"v{rng.randrange(9)}"] + base[k:]) for k in rng.sample(range(25), 2))) for _ in range(60)]
    rows += rows[:20] + [(4, None), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = {r.t: (r.x, r.y) for r in docs.selectExpr("coalesce(text, '') AS t", "xxhash64(coalesce(text, '')) AS x", "xxhash64(1, coalesce(text, '')) AS y").collect()}
    assert sorted(map(tuple, lines.dedup_lines(docs).collect()), key=str) == brute_lines(rows, lambda t: order[t or ""])
    kept = lines.without_repeated_lines(docs.withColumn("bits", F.lit(1)).withColumn("row", F.lit("r")))
    assert kept.columns == ["doc_id", "text", "bits", "row"] and kept.count() == len(rows) and kept.filter("text IS NULL").count() == 2


def test_variants_of_one_line_give_no_row_for_a_pair(spark):
    rng = random.Random(9)
    base = words(rng, 60, 5000).split()
    made = {}
    for n in (200, 400):
        rows = [(i, " ".join(f"x{i}{k}" if k in picked else w for k, w in enumerate(base))) for i in range(n) for picked in [set(rng.sample(range(60), 4))]]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = lines.dedup_lines(docs).collect()
        assert sorted(map(tuple, got), key=str) == brute_lines(rows)
        made[n] = sum(r.n_removed for r in got)
    assert made[200] > 150 and made[400] > 300


@pytest.mark.parametrize("frequent", [0, 3])
def test_lines_whatever_the_rarity_table_holds(spark, monkeypatch, frequent):
    monkeypatch.setattr(lines, "FREQUENT", frequent)
    monkeypatch.setattr(lines, "SELDOM", 2)
    rng = random.Random(10)
    rows = [(i, words(rng, 12, 14)) for i in range(80)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)


def test_plans_of_lines_have_no_text_of_the_rarity_table(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    docs = spark.createDataFrame([(i, words(random.Random(i), 30, 20)) for i in range(40)], "doc_id long, text string")
    assert lines.dedup_lines(docs).count() == 40
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ids = [store.executionsList().apply(k).executionId() for k in range(before, store.executionsCount())]
    texts = [nodes.apply(k).desc() for i in ids for nodes in [store.planGraph(i).allNodes()] for k in range(nodes.size())]
    assert len(texts) > 50 and max(map(len, texts)) < 20_000


# 7: SimHash near-dedup


def test_fingerprint_by_definition():
    import xxhash

    w = "The quick brown FOX jumps".split()
    low = [x.lower() for x in w]
    h = [xxhash.xxh64_intdigest(" ".join(low[i : i + 3]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)
    assert simhash.fingerprint(" ".join(w)) == want
    assert simhash.fingerprint("  \n") == 0 and simhash.fingerprint("A b") == xxhash.xxh64_intdigest("a b", 42)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3))
def test_near_fingerprints_share_a_cell_and_the_bound_is_low(a, bits):
    b = a
    for k in bits:
        b ^= 1 << k
    x = np.array([a, b], np.uint64)
    e = simhash.embed(x)
    assert int(e[0] ^ e[1]).bit_count() <= (a ^ b).bit_count()
    assert all(any((e[0] ^ e[1]) & m == 0 for m in simhash.cells(g)) for g in simhash.GROUPS)


def test_cells_grow_finer():
    assert [simhash.groups_for(n) for n in (10, 10**6, 10**9, 10**11)] == sorted(simhash.groups_for(n) for n in (10, 10**6, 10**9, 10**11)) and simhash.groups_for(10**11) > simhash.groups_for(10**6)
    assert all(len(simhash.cells(g)) == len(set(map(int, simhash.cells(g)))) for g in simhash.GROUPS)


@pytest.mark.parametrize("block, groups", [(2048, 6), (4, 6), (2048, 10)])
def test_links_and_components_by_brute_force(spark, block, groups):
    rng = random.Random(11)
    prints = set()
    for _ in range(30):
        c = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 25])):
            f = c
            for _ in range(rng.randrange(5)):
                f ^= 1 << rng.randrange(64)
            prints.add(f)
    prints = sorted(prints)
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {r.node: r.root for r in components.components(simhash.links(df, block, groups)).collect()}
    groups = defaultdict(set)
    for p in prints:
        groups[root(p)].add(signed(p))
    want = {m: min(g) for g in groups.values() if len(g) > 1 for m in g}
    assert got == want


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(31)
    rows = [(None, ""), (-3, None), (40, "")]
    for _ in range(12):
        base = words(rng, rng.choice([2, 30, 400]), 3000).split()
        for _ in range(rng.choice([1, 3, 12])):
            other = list(base)
            for _ in range(rng.randrange(3)):
                other[rng.randrange(len(other))] = f"n{rng.random()}"
            rows.append((rng.choice([None, rng.randrange(90)]), " ".join(other)))
    rows += rows[5:9]
    prints = [simhash.fingerprint(t or "") for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    least = {r: min((d for (d, _), q in zip(rows, root, strict=True) if q == r and d is not None), default=None) for r in root}
    want = sorted(((d, p if p < 1 << 63 else p - (1 << 64), least[r]) for (d, _), p, r in zip(rows, prints, root, strict=True)), key=str)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "fp", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == want and len(set(root)) < len(rows)


def test_near_duplicates_of_odd_documents(spark):
    got = simhash.near_duplicates(odd_documents(spark)).collect()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.component_id)
    assert by[6] == by[7] == {6} and by[0] == by[1] == by[2] == by[3] == {0} and len(got) == 24
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_one(odd_documents(spark))
    assert 7 not in {r.doc_id for r in kept.collect()} and kept.columns == odd_documents(spark).columns


@pytest.mark.parametrize("block", [2048, 4])
def test_stage_joins_all_texts_from_four_fifths_of_five_word_shingles(spark, block):
    from graphloom.llm import near

    rng, texts = random.Random(12), []
    for _ in range(25):
        base = words(rng, 300, 5000).split()
        texts.append(base)
        for changed in (1, 3, 4, 5, 6, 7, 8):
            other = list(base)
            for at in rng.sample(range(300), changed):
                other[at] = f"new{rng.random()}"
            texts.append(other)
    texts += [["a"] * 3, ["a"] * 3, []]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near.near_copies(docs, block=block).collect()} == dict(enumerate(root))
    assert len(set(root)) < len(texts) - 100 and {r.doc_id for r in simhash.keep_one(docs).collect()} == set(root)


# 9: approximate nearest neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 16))).astype(np.float32)
    x[100:300] = x[100]  # one common vector
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(900)]
    bad = [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [None] + [1.0] * 15, 0), (2080, [], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in range(0, 900, 20)}
    e, hit = x.astype(float), 0
    for q, found in got.items():
        s = e @ e[q]
        order = sorted((i for i in range(900) if i != q), key=lambda i: (-s[i], i))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(s[v] - sc) < 1e-9 for _, v, sc in found)
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(found, found[1:]))
        hit += len(set(order) & {v for _, v, _ in found})
    assert hit / (20 * len(got)) >= 0.9
    few = df.filter("vec_id < 5")
    assert ann.nearest(few, F.col("vec_id") % 20 == 0).count() == 4
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("clustered", [True, False])
def test_neighbours_far_above_a_tile(spark, monkeypatch, clustered):
    monkeypatch.setattr(ann, "TILES", (16, 64))
    rng, n = np.random.default_rng(4), 4000
    x = rng.normal(size=(n, 12))
    if clustered:
        x = 4 * rng.normal(size=(80, 12))[rng.integers(0, 80, n)] + 0.3 * x
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(x)], "vec_id long, embedding array<double>, key string")
    hit, queries = 0, list(range(0, n, 20))
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q in queries:
        s = ann.exact(np.repeat(x[q : q + 1], n, axis=0), x)
        found = sorted(got[q])
        assert len(found) == 20 and all(s[v] == sc for _, v, sc in found)
        order = sorted((i for i in range(n) if i != q), key=lambda i: (-s[i], i))[:20]
        hit += len(set(order) & {v for _, v, _ in found})
    assert hit >= 0.9 * 20 * len(queries)


def test_neighbours_without_an_id_and_of_one_id(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(30)] + [(None, [1.0] * 4), (0, [2.0, 1.0, 0.0, 1.0]), (0, [2.0, 1.0, 0.0, 1.0]), (5, [0.5] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 5).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    known = [(i, np.array(v)) for i, v in rows if i is not None]
    want = defaultdict(list)
    for at, (q, v) in enumerate(known):
        if q % 20 == 0:
            order = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for k, (i, w) in enumerate(known) if k != at)[:5]
            want[q] += [(r, i, -s) for r, (s, i) in enumerate(order, 1)]
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}


def test_hilbert_neighbours_are_cells_side_by_side():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = ann.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# 8, 4: classifiers


def test_language_held_out(spark):
    docs = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet")
    got = langid.op8_langid(spark, SF.replace("sf0.001", "sf0.01")).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_of_odd_documents(spark):
    docs = odd_documents(spark)
    model = langid.fit(docs)
    got = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert (0, "und", 0.0) in got and (1, "und", 0.0) in got and (3, "und", 0.0) in got and any(g[0] == 4 and g[1] == "en" for g in got)
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(empty(spark))).collect()} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0
    assert langid.keep_known(docs).columns == docs.columns


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 20, 100):
        code = langid.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n
        if n >= 4:
            assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 3


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        w = words(rng, 60).split()
        toxic = i % 5 == 0
        if toxic:
            for bad in ("grobble", "snivelkin", "snivelfast"):
                w.insert(rng.randrange(len(w)), bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, lab.filter(~toxicity.held_out(F.col("doc_id"))))
    out = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(900) if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert sum((out[i] >= 0.7) == (i % 5 == 0) for i in held) / len(held) > 0.97


def test_toxicity_of_odd_documents(spark):
    model = toxicity.fit(empty(spark), empty(spark).select("doc_id", F.lit(1).alias("toxic")))
    got = toxicity.score(odd_documents(spark), model).collect()
    assert len(got) == 24 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty(spark), model).count() == 0


def test_grammar_scores_clauses_not_words():
    lexicon = toxicity.Lexicon({"fool": 2.0}, {})
    kinds = lambda t: np.flatnonzero(toxicity.matches(t, lexicon)).tolist()
    assert kinds("what a fool") == [toxicity.PLAIN] and kinds("you fool") == [toxicity.TARGETED]
    assert kinds("that is not a fool") == [toxicity.NEGATED] and kinds("it was said: fool") == [toxicity.PLAIN]
    assert kinds("Anna said what a fool") == [toxicity.REPORTED] and kinds("I will kill you") == [toxicity.THREAT_AT]
    assert kinds("kind words. you. nothing") == [] and kinds("") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(range(13)), max_size=30))
def test_composed_machine_is_its_parts_in_a_row(symbols):
    one = [y for y, _ in toxicity.negation()(symbols)]
    two = [y for y, _ in toxicity.reported()(one)]
    assert [y for y, _ in toxicity.GRAMMAR(symbols)] == [y for y, _ in toxicity.targeted()(two)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["fool", "you", "not", "said", "kill", "tree", "."]), max_size=14))
def test_clauses_by_their_definition(tokens):
    lexicon, want, clause = toxicity.Lexicon({"fool": 2.0}, {}, {"kill": 0.5}), np.zeros(6), []
    for t in [*tokens, "."]:
        if t != ".":
            clause.append(t)
            continue
        by = [0.0] * 6
        for i, w in enumerate(clause):
            neg, said, at = "not" in clause[max(0, i - 3) : i], "said" in clause[:i], "you" in clause
            if w == "fool":
                by[toxicity.NEGATED if neg else toxicity.REPORTED if said else toxicity.TARGETED if at else toxicity.PLAIN] += 2.0
            elif w == "kill" and not neg and not said:
                by[toxicity.THREAT_AT if at else toxicity.THREATENED] += 0.5
        want, clause = want + np.log1p(by), []
    assert np.allclose(toxicity.matches(" ".join(tokens), lexicon), want)


def test_words_and_beginnings():
    lexicon = toxicity.Lexicon({"dolts": 3.0}, {"dolt": 2.0, "doltish": 5.0})
    assert lexicon["dolts"] == (toxicity.INSULT, 3.0) and lexicon["doltishly"] == (toxicity.INSULT, 2.0)
    assert lexicon["dolt"] == (toxicity.INSULT, 2.0) and lexicon["dol"] == (toxicity.OTHER, 0.0) and lexicon["you"][0] == toxicity.TARGET and lexicon["yous"][0] == toxicity.OTHER and lexicon[""] == (toxicity.OTHER, 0.0)


def test_toxic_rows_held_out(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").dropna()
    got = toxicity.op4_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert len(toxic) >= 10 and sum(r.predicted for r in toxic) >= 0.6 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)


# 1: decontamination


def test_benchmark_items_are_found(spark):
    rng = random.Random(9)
    items = [(i, words(rng, rng.randrange(15, 60), 4000).capitalize() + ".") for i in range(40)]
    rows, want = [], set()
    for d in range(300):
        w = words(rng, rng.randrange(20, 400), 4000).split()
        if d % 3 == 0:
            k, t = items[d % 40]
            t = t.split()
            for _ in range(len(t) // 6 if d % 2 else 0):
                t[rng.randrange(len(t))] = f"q{rng.randrange(99)}"
            at = rng.randrange(len(w))
            w[at:at] = t
            want.add((d, k))
        rows.append((d, " ".join(w)))
    rows += [(500, None), (501, ""), (None, items[3][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items + [(90, None), (91, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.search(docs, bench).collect()}
    assert (None, 3) in got
    got = {g for g in got if g[0] is not None}
    assert got <= want and len(got) / len(want) > 0.97
    assert decontaminate.search(docs, bench.limit(0)).count() == 0 and decontaminate.search(docs.limit(0), bench).count() == 0
    assert {r.doc_id for r in decontaminate.without_benchmark(docs, bench).collect()}.isdisjoint({d for d, _ in got})


def test_moments_by_pairs_and_by_rows(monkeypatch):
    rng = random.Random(3)
    ref = decontaminate.Reference([(i, words(rng, 30, 200)) for i in range(9)])
    texts = [words(rng, n, 300) for n in (0, 1, 15, 16, 17, 33, 400)]
    omega, held = np.random.default_rng(1).normal(size=(ref.size, 5)), decontaminate.all_words(texts)
    want = np.zeros((ref.size, 5))
    for w in held:
        b = np.zeros((max(1, -(-len(w) // 16)) + 1, ref.size))
        places, f = ref.features(w)
        np.add.at(b, (places // 16, f), 1)
        p = b[:-1] + b[1:]
        want += p.T @ (p @ omega)
    for most in (8192, 1):
        monkeypatch.setattr(decontaminate, "FEATURES", most)
        moments = decontaminate.Moments(ref.size, omega)
        moments.add(decontaminate.Halves(ref, held))
        assert np.allclose(moments.total(), want, rtol=1e-4, atol=1e-3)


@pytest.mark.parametrize("features", [8192, 300])
def test_search_finds_what_an_exhaustive_one_does(spark, monkeypatch, features):
    monkeypatch.setattr(decontaminate, "FEATURES", features)
    rng = random.Random(19)
    items = [(i % 30, words(rng, rng.randrange(12, 60), 3000) + " answer: " + words(rng, 4, 3000)) for i in range(32)]
    rows = []
    for d in range(250):
        w = words(rng, rng.randrange(30, 300), 3000).split()
        t = rng.choice(items)[1].split()
        for at in rng.sample(range(len(t) - 6), int(rng.choice([0, 0.1, 0.2, 0.3, 0.35]) * len(t))):
            t[at] = f"q{rng.randrange(999)}"
        at = rng.randrange(len(w))
        w[at:at] = t if d % 2 else []
        rows.append((d, " ".join(w)))
    rows += [rows[1], (None, items[0][1]), (900, None), (901, " ".join(words(rng, 200000, 3000).split()[:150000]) + " " + items[5][1])]
    docs = spark.createDataFrame([(d, t, "x", 1.0) for d, t in rows], "doc_id long, text string, item_id string, share double")
    want = set()
    for d, t in rows[:250]:
        w = decontaminate.words(t or "")
        for k, text in items:
            item, answer = decontaminate.words(text).tolist(), decontaminate.words(decontaminate.answer_of(text)).tolist()
            if any(decontaminate._verified(w, p, item, answer) for p in range(max(1, len(w) // decontaminate.HALF))):
                want.add((d, k))
    got = decontaminate.search(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    by = Counter((r.doc_id, r.item_id) for r in got)
    found = {g for g in by if g[0] is not None and g[0] < 250}
    assert found <= want and len(want) > 100 and len(found) >= 0.9 * len(want)
    assert {i for d, i in by if d is None} == {0} and (901, 5) in by and by[1, rows_item(by, 1)] == 2


def rows_item(by, doc):
    return next(i for d, i in by if d == doc)


def test_subsequence_in_bits():
    assert decontaminate.common_words([1, 2, 3, 4], [9, 1, 3, 9, 4]) == 3 and decontaminate.common_words([1], []) == 0


# 10: licences


def test_licences():
    scanner = licenses.Scanner()
    name = lambda t: scanner(t)[0]
    assert name("Licensed under the Apache License, Version 2.0.") == "Apache-2.0" and name("Released under the MIT License.") == "MIT"
    assert name("This work is licensed under the GNU General Public License, version 2.") == "GPL-2.0" and name("This work is licensed under the GNU General Public License, version 3.") == "GPL-3.0"
    assert name("Licensed under CC BY-NC 4.0.") == "CC-BY-NC-4.0" and name("Licensed under CC BY 4.0.") == "CC-BY-4.0"
    assert name("You need a licence to drive here.") is None and scanner("Licensed under CC BY-SA 4.0.")[2] == 0


def test_licence_blocks(spark):
    docs = spark.createDataFrame([(1, "Some text.\nReleased under the MIT License.\nMore."), (2, None), (3, ""), (4, "x " * 5000 + "Licensed under CC BY 4.0. " + "y " * 50)], "doc_id long, text string")
    got = {(r.doc_id, r.license, r.block) for r in licenses.scan(docs).collect()}
    assert (1, "MIT", "Released under the MIT License.") in got and any(g[0] == 4 and g[1] == "CC-BY-4.0" for g in got) and {g[0] for g in got} == {1, 4}
    assert licenses.scan(empty(spark)).count() == 0


def licences_of(text):
    return [x[2] for x in licenses.Scanner().scan(text) if x[2]]


def test_licences_in_long_sentences():
    rng = random.Random(4)
    prose = "".join(rng.choice("abcdefghij klmnop qrst ") for _ in range(9000))
    for notice, name in (("Released under the MIT License", "MIT"), ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"), ("Licensed under the Apache License, Version 2.0", "Apache-2.0"), ("Licensed under the GNU GPL v2", "GPL-2.0")):
        for before in (0, 200, 4080, 4096, 8900):
            assert licences_of(prose[:before] + " " + notice + " " + prose[:before]) == [name]


def test_licences_one_after_another(spark):
    three = "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nDistributed under the Apache License 2.0, see the accompanying file LICENSE."
    docs = spark.createDataFrame([(1, three, "x", 1), (1, three, "x", 1), (None, three, None, None)], "doc_id long, text string, license string, start int")
    assert sorted(r.license for r in licenses.scan(docs).collect()) == ["Apache-2.0"] * 3 + ["CC-BY-NC-4.0"] * 3 + ["MIT"] * 3
    many = "\n".join([f"The license of this part is given by the line below, says part {i}." for i in range(58)] + ["Released under the MIT License."] * 40)
    for at in range(0, 30, 10):
        assert licences_of("licence " + "z" * at + ".\n" + many) == ["MIT"] * 40


def test_every_template_is_found_with_its_differing_words():
    scanner, rng = licenses.Scanner(), random.Random(14)
    for name, ps in licenses.phrases().items():
        for phrase in ps:
            own = licenses.words_of(phrase)
            before = " ".join(f"b{rng.randrange(99)}x" for _ in range(30))
            rows = [r for r in scanner.scan(f"{before}. {phrase} {before}") if r[2]]
            found = rows[0][2] if rows else None
            assert found == name or (phrase in licenses.OPENINGS["BSD-2-Clause"] and found == "BSD-2-Clause"), phrase
            free = [i for i, w in enumerate(own) if w not in licenses.TELLING and not licenses.TRIGGER.search(w)]
            if len(free) > 9:
                text = list(own)
                text[free[5]] = "otherword"
                rows = [r for r in scanner.scan(f"{before}. {' '.join(text)} {before}") if r[2]]
                assert rows and rows[0][2] == name and rows[0][4] <= 2, phrase


def brute_closest(own, text, most):
    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
            row = new
        return row[-1]

    best = min((far(own, text[p:q]) for p in range(len(text) + 1) for q in range(p, len(text) + 1)), default=len(own))
    return best if best <= most else None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=6), st.lists(st.integers(0, 4), max_size=12))
def test_closest_stretch_by_brute_force(own, text):
    most = len(own) // 3
    got = list(licenses.closest(np.array(own), np.array(text, int), most))
    assert (min(got)[0] if got else None) == brute_closest(own, text, most)
    for d, p, q in got:
        assert len(licenses.differing(list(map(str, own)), list(map(str, text[p:q])))) == d
    assert all(b <= c or d <= a for (_, a, b), (_, c, d) in ((x, y) for i, x in enumerate(got) for y in got[:i]))


def test_licence_headers_and_titles():
    assert licences_of("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\nEveryone may copy.") == ["GPL-2.0"] and licences_of("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n") == ["LGPL-3.0"]
    assert licences_of("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy") == ["MPL-2.0"]
    assert licences_of(licenses.TEXTS["BSD-3-Clause"]) == ["BSD-3-Clause"] and licences_of("x " * 3000 + "\n" + licenses.TEXTS["MIT"].replace("AUTHORS", "WRITERS")) == ["MIT"]
    more = {"Own-1": "Whoever reads this notice holds permission to do with the thing whatever seems good to them and to tell others so"}
    assert [r[2] for r in licenses.Scanner(more).scan("Some prose. " + more["Own-1"] + ".")] == ["Own-1"]
    two = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice.\n"
    third = "3. Neither the name of the copyright holder nor the names of its contributors\nmay be used to endorse or promote products derived from this software without permission.\n"
    assert licences_of(two) == ["BSD-2-Clause"] and licences_of(two + third) == ["BSD-3-Clause"]


# queries and pipeline


def test_contract_columns(spark):
    want = {"op2_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op4_toxicity": ["doc_id", "held_out", "score", "predicted"], "op7_simhash": ["doc_id", "fingerprint", "component_id"], "op8_langid": ["doc_id", "held_out", "lang_pred", "score"]}
    for name, cols in want.items():
        df = registry.queries()[name](spark, SF)
        assert df.columns[: len(cols)] == cols and df.count() == 200


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, SF).persist()
        assert after.columns == docs.columns and after.count() <= before.count(), name
        before = after
    last = P.STAGES[-1][1](spark, before, SF)
    assert last.count() == before.count() and {r.doc_id for r in last.collect()} == {r.doc_id for r in before.collect()}

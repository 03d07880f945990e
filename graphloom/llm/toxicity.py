"""Toxicity by a weighted finite-state pattern grammar.

Five lexical transducers read a word letter by letter and write its symbol (insult,
threat, target, negation, reported speech; other where none accepts) with a weight; their
union is one trie. Weights of insults and threats are learnt from labelled rows; insults
themselves are words and word beginnings that stand in toxic texts far more often than in
others. Four more transducers rewrite the symbols of a clause: one reads it from its end
and marks what has a target ahead; negation marks what stands shortly behind a negation,
reported speech what stands behind a verb of saying, target what has a target before it
and names the kinds of match. The last three are composed into one machine, so that a
clause is read once in either direction. Clauses end at . ! ? ; : and line ends. A
logistic model over the weights of matched clauses by kind gives the score, so that a
word by itself, unless its clause matches, counts for nothing.

Null and empty texts match nothing and get the score of an unmatched text. Repeated rows
are scored each; a very long text is read clause by clause. A doc_id with both labels is
labelled 1. With no labelled rows, or rows of one label only, the prior weights of the
grammar stand.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

#: Labelled rows learnt from, of labels 1 and 0 at most about so many (a bounded sample, chosen by a hash of doc_id).
SAMPLE, SAMPLE_CLEAN = 4000, 16000
#: Most entries of the learnt lexicon, least log-odds of one, and least number of toxic texts that hold it.
LEXICON, LEAST_ODDS, LEAST_TEXTS = 4000, 3.2, 6
#: Lengths of word beginnings that may become entries.
STEMS = range(4, 10)
THRESHOLD = 0.7

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
#: Closed word classes in English, German, French and Spanish.
WORDS = {
    TARGET: "you your yours yourself u he him she her they them those these du dich dir dein deine ihr euch euer sie er tu te toi vous votre il elle ils elles lui tú ti tu usted ustedes él ella ellos ellas vosotros",
    NEGATION: "not no never none nobody isn't aren't wasn't don't doesn't didn't won't can't nicht kein keine keinen keiner nie niemals pas jamais aucun aucune nunca jamás ningún ninguna",
    REPORT: "said says say saying told tells wrote writes reported reports quoted claimed claims called sagte sagt schrieb nannte meinte dit disait écrit dice dijo escribió",
    THREAT: "kill killing murder hurt destroy beat shoot stab die töten umbringen verprügeln sterben tuer frapper mourir matar morir golpear",
}
_TOKENS = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:\n]")
_ENDS = set(".!?;:\n")
#: How a matched insult or threat was rewritten, and the prior weight of each kind for the model.
PLAIN, TARGETED, NEGATED, REPORTED, THREATENED, THREAT_AT = range(6)
PRIOR = np.array([1.5, 2.0, 0.3, 0.5, 0.7, 2.0])
PRIOR_BIAS = -3.0


#: Symbols between the transducers: negated, reported, and with a target somewhere in the clause.
NOT_INSULT, NOT_THREAT, SAID_INSULT, SAID_THREAT, INSULT_AT, THREATS_AT = range(7, 13)
SYMBOLS = range(13)


class Transducer:
    """Sequential weighted transducer. arcs[state][symbol] is (output, weight, next state); a symbol without an arc stays as it is, as does the state. State 0 is the first."""

    def __init__(self, arcs: list[dict[int, tuple[int, float, int]]]):
        self.arcs = [{x: row.get(x, (x, 1.0, state)) for x in SYMBOLS} for state, row in enumerate(arcs)]

    def __call__(self, symbols: list[int]) -> list[tuple[int, float]]:
        """What is written, and the weight of each arc taken."""
        state, out = 0, []
        for x in symbols:
            y, w, state = self.arcs[state][x]
            out.append((y, w))
        return out

    def compose(self, other: Transducer) -> Transducer:
        """The machine that gives other's output on this one's, weights multiplied; only states that can be reached."""
        number, todo, rows = {(0, 0): 0}, [(0, 0)], []
        for a, b in todo:
            row = {}
            for x in SYMBOLS:
                y, v, c = self.arcs[a][x]
                z, w, d = other.arcs[b][y]
                if (c, d) not in number:
                    number[c, d] = len(todo)
                    todo.append((c, d))
                row[x] = (z, v * w, number[c, d])
            rows.append(row)
        return Transducer(rows)


def ahead() -> Transducer:
    """Reads a clause from its end: what has a target behind it in the text."""
    return Transducer([{TARGET: (TARGET, 1.0, 1)}, {INSULT: (INSULT_AT, 1.0, 1), THREAT: (THREATS_AT, 1.0, 1), END: (END, 1.0, 0)}])


def negation(reach: int = 3) -> Transducer:
    """State k: so many words are left in which a negation holds."""

    def row(k: int) -> dict[int, tuple[int, float, int]]:
        out = {x: (x, 1.0, max(0, k - 1)) for x in SYMBOLS}
        out[NEGATION], out[END] = (NEGATION, 1.0, reach), (END, 1.0, 0)
        if k:
            out |= {x: (NOT_INSULT, 1.0, k - 1) for x in (INSULT, INSULT_AT)} | {x: (NOT_THREAT, 1.0, k - 1) for x in (THREAT, THREATS_AT)}
        return out

    return Transducer([row(k) for k in range(reach + 1)])


def reported() -> Transducer:
    """State 1: a verb of saying stood before."""
    said = {x: (SAID_INSULT, 1.0, 1) for x in (INSULT, INSULT_AT)} | {x: (SAID_THREAT, 1.0, 1) for x in (THREAT, THREATS_AT)}
    return Transducer([{REPORT: (REPORT, 1.0, 1)}, {**said, END: (END, 1.0, 0)}])


def targeted() -> Transducer:
    """State 1: a target stood before."""
    return Transducer([{TARGET: (TARGET, 1.0, 1)}, {INSULT: (INSULT_AT, 1.0, 1), THREAT: (THREATS_AT, 1.0, 1), END: (END, 1.0, 0)}])


AHEAD, GRAMMAR = ahead(), negation().compose(reported()).compose(targeted())
#: Kinds of match by the symbol that the grammar writes; negated and reported threats match nothing.
KINDS = {INSULT: PLAIN, INSULT_AT: TARGETED, NOT_INSULT: NEGATED, SAID_INSULT: REPORTED, THREAT: THREATENED, THREATS_AT: THREAT_AT}


class Trie:
    """Lexical transducer over letters: a path that ends in a final state writes its symbol and weight; a beginning's state accepts whatever follows."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: dict[int, tuple[int, float]] = {}
        self.open: dict[int, tuple[int, float]] = {}

    def add(self, text: str, found: tuple[int, float], beginning: bool = False) -> None:
        state = 0
        for c in text:
            if c not in self.arcs[state]:
                self.arcs.append({})
                self.arcs[state][c] = len(self.arcs) - 1
            state = self.arcs[state][c]
        (self.open if beginning else self.final)[state] = found

    def __call__(self, word: str) -> tuple[int, float]:
        """A whole word before beginnings, a shorter beginning before a longer one."""
        state, found = 0, None
        for c in word:
            state = self.arcs[state].get(c, -1)
            if state < 0:
                return found or (OTHER, 0.0)
            if found is None and state in self.open:
                found = self.open[state]
        return self.final.get(state) or found or (OTHER, 0.0)


class Lexicon(dict):
    """The union of the lexical transducers: word -> (symbol, weight); words seen are remembered up to a bound."""

    def __init__(self, entries: dict[str, float], stems: dict[str, float], threats: dict[str, float] | None = None):
        super().__init__()
        self.trie = Trie()
        for k, ws in WORDS.items():
            for w in ws.split():
                self.trie.add(w, (k, (threats or {}).get(w, 1.0) if k == THREAT else 1.0))
        for e in _ENDS:
            self.trie.add(e, (END, 0.0))
        for w, x in entries.items():
            self.trie.add(w, (INSULT, x))
        for w, x in stems.items():
            self.trie.add(w, (INSULT, x), beginning=True)

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = self.trie(word)
        return found


def matches(text: str, lexicon: Lexicon) -> np.ndarray:
    """Weight of matched clauses by kind."""
    total = np.zeros(6)
    symbols = list(map(lexicon.__getitem__, _TOKENS.findall(text.lower())))
    kinds = [s[0] for s in symbols]
    if INSULT not in kinds and THREAT not in kinds:
        return total
    start, n = 0, len(kinds)
    while start < n:
        try:
            stop = kinds.index(END, start)
        except ValueError:
            stop = n
        clause = kinds[start:stop]
        if INSULT in clause or THREAT in clause:
            by_kind = [0.0] * 6
            marked = [y for y, _ in AHEAD(clause[::-1])][::-1]
            for (y, arc), (_, w) in zip(GRAMMAR(marked), symbols[start:stop], strict=True):
                if y in KINDS:
                    by_kind[KINDS[y]] += arc * w
            total += np.log1p(by_kind)
        start = stop + 1
    return total


def _features(total: np.ndarray) -> np.ndarray:
    return np.log1p(total)


def _counts(rows: DataFrame) -> DataFrame:
    """(feature, toxic, texts that hold it); features are words (=word) and their beginnings."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = {w for w in _TOKENS.findall(text.lower()) if len(w) > 2}
                seen[toxic].update({"=" + w for w in words} | {w[:n] for w in words for n in STEMS if n < len(w)})
        for k, one in enumerate(seen):
            if one:
                yield pa.RecordBatch.from_arrays([pa.array(list(one)), pa.array([k] * len(one), pa.int32()), pa.array(list(one.values()), pa.int64())], names=["feature", "toxic", "n"])

    return rows.mapInArrow(work, "feature string, toxic int, n long").groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, clean: int = SAMPLE_CLEAN) -> bytes:
    """A model, as bytes, from the labelled rows given. Half of the sample teaches the lexicon, the other half the weights of the matches."""
    labels = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1)).na.drop()
    totals = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share = F.when(F.col("toxic") == 1, min(1.0, sample / max(1, totals.get(1, 0)))).otherwise(min(1.0, clean / max(1, totals.get(0, 0))))
    chosen = labels.filter(draw < share).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # two numbers for each row of the bounded sample
    rows = common.written(common.keyed(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").repartition(12, "doc_id"), "toxic-sample")
    first = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(6)), F.lit(2)) == 0
    size = {(r["first"], r["toxic"]): r["n"] for r in rows.groupBy(first.alias("first"), "toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = size.get((True, 1), 0), size.get((True, 0), 0)
    odds = F.log((F.col("p") + 0.5) / (pos + 1.0)) - F.log((F.col("n") + 0.5) / (neg + 1.0))
    counted = common.written(_counts(rows.filter(first)).withColumn("odds", odds), "toxic-counts")
    found = counted.filter((F.col("odds") >= LEAST_ODDS) & (F.col("p") >= LEAST_TEXTS)).orderBy(F.desc("odds"), "feature").limit(LEXICON).collect() if pos and neg else []
    # what a threat weighs: its log-odds, drawn to 1 where it is seldom seen
    known = counted.filter(F.col("feature").isin([f"={w}" for w in WORDS[THREAT].split()])).collect() if pos and neg else []
    threats = {r["feature"][1:]: max(0.05, (float(r["odds"]) * (r["p"] + r["n"]) + LEAST_TEXTS) / (r["p"] + r["n"] + LEAST_TEXTS)) for r in known}
    stems: dict[str, float] = {}
    for r in sorted((r for r in found if r["feature"][0] != "="), key=lambda r: (len(r["feature"]), r["feature"])):
        if not any(r["feature"][:n] in stems for n in STEMS):
            stems[r["feature"]] = float(r["odds"])
    entries = {r["feature"][1:]: float(r["odds"]) for r in found if r["feature"][0] == "="}
    weights, bias = PRIOR, PRIOR_BIAS
    if size.get((False, 1), 0) and size.get((False, 0), 0):

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = Lexicon(entries, stems, threats)
            for batch in batches:
                x = [matches(t, lexicon).tolist() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

        got = rows.filter(~first).mapInArrow(work, "y int, x array<double>").collect()  # six numbers for each row of the sample
        weights, bias = _logistic(_features(np.array([r["x"] for r in got])), np.array([r["y"] for r in got], float))
        # the sample holds the labels in other shares than the rows do
        rate = lambda k: totals[k] / max(1, sum(r["y"] == k for r in got))
        bias += math.log(rate(1) / rate(0))
    return pickle.dumps((entries, stems, threats, np.asarray(weights).tolist(), float(bias)))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton steps; weights are drawn to the prior of the grammar, so that kinds without examples keep it."""
    x, w = np.c_[x, np.ones(len(x))], np.r_[PRIOR, PRIOR_BIAS]
    prior, pull = w.copy(), np.r_[np.full(len(PRIOR), ridge), 0.05]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * (w - prior))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], w[-1]


def score(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, and the matched weight of each kind, for every row. The lexicon sent out has a bound."""
    sent = common.bounded(docs.sparkSession, model, 16 << 20)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, stems, threats, weights, bias = pickle.loads(sent.value)
        lexicon, weights = Lexicon(entries, stems, threats), np.array(weights)
        for whole in batches:
            for batch in common.slices(whole):
                x = np.array([matches(t, lexicon) for t in batch.column("text").to_pylist()])
                p = 1 / (1 + np.exp(-np.clip(_features(x) @ weights + bias, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "score", "matched"])

    return common.keyed(docs, id_col, text_col).mapInArrow(work, "doc_id long, score double, matched array<double>")


def held_out(col):
    return F.coalesce(common.crc_mod(col, 3) == 1, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    found = score(docs, fit(docs, labels.filter(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

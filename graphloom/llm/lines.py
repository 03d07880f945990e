r"""Line dedup by an exact set-similarity join, with DataFrame functions only.

A line is the set of its words (runs of characters other than blank and \t\x0B\f\r).
Words are ordered by rarity, counted over all texts; two sets with a Jaccard similarity
of four fifths or more must share a word among the first few of each in that order
(prefix filter). Lines that meet at such a word go on if their sizes allow the similarity
(length filter) and so does what can still follow the first word they share (positional
filter, which the first shared word of a similar pair always passes), and if 128 parities
of their words differ in few enough places; then the words themselves decide. A line
goes if an earlier line, by document and place, is similar; lines are judged as they stand
in the input.

Equal lines, known by 128 bits, are one line from the first aggregation on, which keeps
their first place. Both joins are semi-joins: they ask whether a partner exists, stop at
the first and give a row for a line, never one for a pair. The first finds lines that have
a plausible partner, and at which words; only those fetch their words for the second, whose
condition compares them. A line's fate reaches its document as bits by line number, not as
a row for a copy.

Null and empty texts are one empty line. Lines without words stay. A null doc_id counts
as before all others. Rows that share a doc_id stand in the order of a hash of their texts;
rows equal in both are one document, so that each keeps what the other keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

#: Least similarity, as a fraction.
LEAST = (4, 5)
#: Words told apart by how often they occur, at most so many, in so many buckets: what the rarity table may hold. Rarer words count alike and come first.
FREQUENT, BUCKETS = 1 << 16, 1 << 18
#: Words seen less often than this are never in the table.
SELDOM = 16
#: Lines of more words have 128 parities, others 64.
LONG = 64
_BLANKS, _SPACE, _HASH_BITS = " \t\x0b\f\r", r"[ \t\x0B\f\r]+", 56
_ROW, _LINE = ["did", "x", "y"], ["a", "b"]


def _lines(texts: DataFrame) -> DataFrame:
    """(did, x, y, no, line): lines with words, without blanks at their ends."""
    lines = texts.select(*_ROW, F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    return lines.withColumn("line", F.btrim("line", F.lit(_BLANKS))).filter("line <> ''")


def _rarity(texts: DataFrame) -> Column:
    """An array by hash bucket: the greatest number of occurrences of a frequent word in it, as a logarithm in the high bits, or 0. Its size has a bound whatever the corpus; the bar for a frequent word rises until they fit."""
    words = texts.select(F.explode(F.split("text", r"[ \t\x0B\f\r\n]+")).alias("w")).filter("w <> ''")
    often = common.written(words.groupBy(F.xxhash64("w").alias("h")).agg(F.count("*").alias("n")).filter(F.col("n") >= SELDOM), "often")
    by_size = sorted(((r["k"], r["many"]) for r in often.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("many")).collect()), reverse=True)
    total, bar = 0, 1 << 62
    for k, many in by_size:  # 63 rows at most
        total += many
        if total > FREQUENT:
            break
        bar = 1 << k
    level = (F.floor(F.log2("n") * 2.5) + 1).cast("int")
    table = ["0"] * BUCKETS
    for r in often.filter(F.col("n") >= bar).groupBy(F.col("h").bitwiseAND(BUCKETS - 1).alias("b")).agg(F.max(level).alias("x")).collect():  # FREQUENT rows at most
        table[r["b"]] = str(r["x"] << _HASH_BITS)
    common.dropped(often)
    return F.split(F.lit(",".join(table)), ",").cast("array<bigint>")  # a subquery can't stand in a lambda


def _with_sets(lines: DataFrame, rarity: Column) -> DataFrame:
    """s in place of the line: its distinct words as numbers, rarest first: rarity in the high bits, the word's hash in the low ones; and a, b, 128 bits of the line."""

    def number(h: Column) -> Column:
        level = F.coalesce(F.get(rarity, h.bitwiseAND(BUCKETS - 1).cast("int")), F.lit(0).cast("long"))
        return level.bitwiseOR(h.bitwiseAND((1 << _HASH_BITS) - 1))

    hashes = F.transform(F.split("line", _SPACE), lambda w: F.xxhash64(w))
    return lines.select(*_ROW, "no", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), F.sort_array(F.array_distinct(F.transform(hashes, number))).alias("s"))


def _distinct(texts: DataFrame, rarity: Column) -> DataFrame:
    """(a, b, at, n, low, high, prefix): every distinct line once; at is its first place, low and high are parities of its words by hash (of short lines low holds them all, else they are dealt to both), prefix the words of which a similar line must share one."""
    most, of = LEAST

    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(63).cast("int"))
    zero = F.lit(0).cast("long")
    every = F.aggregate("s", zero, lambda a, k: a.bitwiseXOR(bit(k)))
    half = F.when(F.size("s") > LONG, F.aggregate("s", zero, lambda a, k: F.when(k.bitwiseAND(64) == 64, a.bitwiseXOR(bit(k))).otherwise(a))).otherwise(zero)
    n = F.size("s")
    need = F.expr(f"cast(({most} * size(s) + {of - 1}) div {of} as int)")  # words that a set of any size must share with this one
    sets = _with_sets(_lines(texts), rarity).select(*_ROW, "no", *_LINE, n.alias("n"), every.alias("low"), half.alias("high"), F.slice("s", 1, n - need + 1).alias("prefix"))
    sets = sets.withColumn("low", F.col("low").bitwiseXOR(F.col("high")))
    return sets.groupBy(*_LINE).agg(F.min(F.struct(*_ROW, "no")).alias("at"), *(F.first(c).alias(c) for c in ("n", "low", "high", "prefix")))


def _could_be() -> Column:
    """Prefix, length, positional and parity filters for rows l and r of a word each."""
    most, of = LEAST
    n, m, i, j = (F.col(c) for c in ("l.n", "r.n", "l.i", "r.i"))
    low, high = (F.col(f"l.{h}").bitwiseXOR(F.col(f"r.{h}")) for h in ("low", "high"))
    few = lambda apart: (most + of) * apart <= (of - most) * (n + m)
    alike = few(F.bit_count(low.bitwiseXOR(high))) & (((F.col("l.high") == 0) != (F.col("r.high") == 0)) | few(F.bit_count(low) + F.bit_count(high)))
    other = (F.col("l.a") != F.col("r.a")) | (F.col("l.low") != F.col("r.low")) | (F.col("l.high") != F.col("r.high"))
    # shared / (n + m - shared) >= most / of, so shared >= (n + m) * most / (most + of)
    return (F.col("l.t") == F.col("r.t")) & other & (of * n >= most * m) & (of * m >= most * n) & ((most + of) * F.least(n - i, m - j) >= most * (n + m)) & alike


def _similar_to_earlier(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of the distinct lines to which an earlier one is similar."""
    most, of = LEAST
    rows = lines.select("a", "n", "low", "high", F.posexplode("prefix").alias("i", "t"))
    plausible = common.written(rows.alias("l").join(rows.alias("r"), _could_be(), "left_semi").select("a", "t", "i"), "plausible")
    some = lines.join(plausible, "a", "left_semi").select(*_LINE, "at", "at.*", "n", "low", "high")
    # their words, from the texts they stand in first; a document's places are one row
    places = some.groupBy(*_ROW).agg(F.collect_list(F.struct("no", *_LINE, "at", "n", "low", "high")).alias("places"))
    held = texts.join(places, _ROW).select(F.split("text", "\n", -1).alias("parts"), F.explode("places").alias("p"))
    words = F.array_join(F.array_distinct(F.split(F.btrim(F.get("parts", F.col("p.no")), F.lit(_BLANKS)), _SPACE)), " ")
    sets = held.select("p.a", "p.b", "p.at", "p.n", "p.low", "p.high", words.alias("w")).dropDuplicates(_LINE)
    rows = common.written(sets, "sets").join(plausible, "a")  # at the words where they have a plausible partner
    same = (most + of) * F.size(F.array_intersect(F.split("l.w", " "), F.split("r.w", " "))) >= most * (F.col("l.n") + F.col("r.n"))
    gone = common.written(rows.alias("l").join(rows.alias("r"), _could_be() & (F.col("r.at") < F.col("l.at")) & same, "left_semi").select(*_LINE).distinct(), "gone")
    common.dropped(plausible)
    return gone


def _kept_bits(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The texts; and (did, x, y, bits): a bit for every line that stays because it is the first of its kind, 64 lines in a long."""
    texts = common.rows_known(docs, id_col, text_col)
    with common.short_plans(docs.sparkSession):
        lines = common.written(_distinct(texts, _rarity(texts)), "lines")
        gone = _similar_to_earlier(lines, texts)
        kept = lines.join(gone, _LINE, "left_anti").select("at.*").select(*_ROW, F.shiftright("no", 6).alias("k"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("no").bitwiseAND(63)).alias("bits"))
        none = texts.select(*_ROW, F.explode(F.sequence(F.lit(0), F.shiftright(F.size(F.split("text", "\n", -1)) - 1, 6))).alias("k"), F.lit(0).cast("long").alias("bits"))
        by_long = kept.unionByName(none).groupBy(*_ROW, "k").agg(F.bit_or("bits").alias("bits"))
        bits = common.written(by_long.groupBy(*_ROW).agg(F.sort_array(F.collect_list(F.struct("k", "bits")))["bits"].alias("bits")), "kept")
        common.dropped(lines, gone)
    return texts, bits


def _lines_left(parts: Column, bits: Column) -> Column:
    on = lambda i: F.call_function("shiftright", F.get(bits, F.shiftright(i, 6)), i.bitwiseAND(63)).bitwiseAND(1) == 1
    return F.filter(parts, lambda x, i: on(i) | (F.btrim(x, F.lit(_BLANKS)) == ""))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and kept (the lines left, joined again) for every row."""
    texts, bits = _kept_bits(docs, id_col, text_col)
    parts = texts.join(bits, _ROW).select("doc_id", F.split("text", "\n", -1).alias("lines"), "bits")
    left = parts.select("doc_id", F.size("lines").alias("n"), _lines_left(F.col("lines"), F.col("bits")).alias("left"))
    return left.select("doc_id", F.col("n").cast("long").alias("n_lines"), (F.col("n") - F.size("left")).cast("long").alias("n_removed"), F.array_join("left", "\n").alias("kept"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with repeated lines taken out of their texts; same columns. Rows with a null text keep it."""
    _, bits = _kept_bits(docs, "doc_id", "text")
    whole = F.struct(*docs.columns)
    own = docs.select(whole.alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), F.coalesce("text", F.lit("")).alias("_t"))
    own = own.withColumns({"x": F.xxhash64("_t"), "y": F.xxhash64(F.lit(1), "_t")}).drop("_t")
    left = F.array_join(_lines_left(F.split("row.text", "\n", -1), F.col("bits")), "\n")
    return own.join(bits, _ROW).select(*(F.when(F.col("row.text").isNotNull(), left).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS no, parts[i] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)
), sets AS (
  SELECT line, min((doc_id, no)) AS pos, list_sort(list_distinct(list_filter(regexp_split_to_array(line, '[ \t\x0B\f\r]+'), lambda w: w <> ''))) AS s
  FROM lines GROUP BY line
), words AS (
  SELECT line, pos, s, len(s) AS n, unnest(s) AS w FROM sets
), often AS (SELECT w, count(*) AS f FROM words GROUP BY w),
placed AS (
  SELECT line, pos, s, n, w, row_number() OVER (PARTITION BY line ORDER BY f, w) AS r FROM words JOIN often USING (w)
), prefix AS (
  SELECT * FROM placed WHERE r <= n - ceil(n * 0.8 - 1e-9) + 1
), near_lines AS (
  SELECT DISTINCT a.line FROM prefix a JOIN prefix b ON a.w = b.w AND a.line <> b.line AND b.pos < a.pos AND b.n >= a.n * 0.8 - 1e-6 AND a.n >= b.n * 0.8 - 1e-6
  WHERE len(list_intersect(a.s, b.s)) >= (a.n + b.n - len(list_intersect(a.s, b.s))) * 0.8 - 1e-9
), judged AS (
  SELECT l.doc_id, l.no, l.line, len(s.s) > 0 AND ((l.doc_id, l.no) > s.pos OR m.line IS NOT NULL) AS gone
  FROM lines l JOIN sets s ON l.line = s.line LEFT JOIN near_lines m ON l.line = m.line
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

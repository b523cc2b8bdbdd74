"""What quality filters remove together and alone, in every order, from the counts of joint failures."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of these characters divide words.
SPACE = r"[\x20\x09-\x0D]+"


def failures(docs: DataFrame, min_words: int = 50, distinct_percent: int = 65, upper_percent: int = 5, symbols: str = "#$%&*|") -> DataFrame:
    """(doc_id, part, digest, A, B, C, D) for every row of docs; a flag is 1 where the text fails the filter.

    A: fewer words than min_words; B: fewer than distinct_percent of the words
    are distinct; C: more than upper_percent of the code points are A-Z; D:
    holds one of the symbols. digest is the text's SHA-256. A null text counts
    as an empty one, which fails A only; a null source as part ''.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    flag = lambda fails: fails.cast("long")
    held = "[" + "".join(f"\\{c}" for c in symbols) + "]"
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        flag(F.size(words) < min_words).alias("A"), flag(100 * F.size(F.array_distinct(words)).cast("long") < distinct_percent * F.size(words).cast("long")).alias("B"),
        flag(100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > upper_percent * F.length(text).cast("long")).alias("C"), flag(text.rlike(held)).alias("D"),
    )


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic, 1 where a label of the doc_id says so; an unlabelled or null doc_id has 0."""
    most = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(most("quality").alias("good"), most("toxic").alias("toxic"))
    return rows.join(known, F.col("doc_id") == F.col("_doc"), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")}).drop("_doc")


def with_copies(rows: DataFrame, names: list[str], label: str = "E") -> DataFrame:
    """(part, *names, label, good, toxic, n): how many documents share these; label is 1 for copies of a smaller doc_id's text.

    Copies meet as counts by digest, part and labels, so that a text that a
    third of all documents share is a few rows when its smallest doc_id is
    looked up. Rows without a doc_id are no copies, and rows that repeat the
    smallest doc_id aren't either.
    """
    own = ["digest", "part", *names, "good", "toxic"]
    once = rows.groupBy("doc_id", *own).agg(F.count("*").alias("n"))
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    met = once.groupBy(*own).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("n_least"), nameless.alias("nameless"))
    first = met.groupBy(F.col("digest").alias("_digest")).agg(F.min("least").alias("first"))
    found = met.join(first, F.col("digest") == F.col("_digest"))
    single = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    both = F.array(F.struct(F.lit(0).cast("long").alias("copy"), single.alias("n")), F.struct(F.lit(1).cast("long").alias("copy"), (F.col("n") - single).alias("n")))
    return found.select("part", *names, "good", "toxic", F.explode(both).alias("_c")).select("part", *names, F.col("_c.copy").alias(label), "good", "toxic", F.col("_c.n").alias("n")).filter("n > 0")


def joint_failures(rows: DataFrame, names: list[str]) -> DataFrame:
    """(part, joint, joint_good, joint_toxic): for every subset of the filters, the documents that fail all of it.

    A subset is the array's index, its bits the filters in their order; entry 0
    counts all documents. Each entry is a sum of products of flags.
    """

    subsets = [[name for i, name in enumerate(names) if t >> i & 1] for t in range(1 << len(names))]
    counts = lambda *weight: F.expr(f"array({', '.join(f'sum({' * '.join([*weight, *t])})' for t in subsets)})")
    return rows.groupBy("part").agg(counts("n").alias("joint"), counts("n", "good").alias("joint_good"), counts("n", "toxic").alias("joint_toxic"))


def _sums(joint: str, factors: list[dict[int, int]]) -> Column:
    """An array with a sum for each dict: the joint count of every subset, times the subset's factor."""
    return F.expr(f"array({', '.join(' + '.join(f'{joint}[{t}] * {by}L' for t, by in f.items()) for f in factors)})")


def survivors(joint: str, n: int) -> Column:
    """For every set of filters the documents that fail none of it: the Möbius inverse of the joint failures."""
    return _sums(joint, [{t: (-1) ** t.bit_count() for t in range(1 << n) if t & ~applied == 0} for applied in range(1 << n)])


def unique_failures(joint: str, n: int) -> Column:
    """For every filter the documents that fail it only."""
    return _sums(joint, [{t: -((-1) ** t.bit_count()) for t in range(1 << n) if t >> i & 1} for i in range(n)])


def shapley_totals(joint: str, n: int) -> Column:
    """For every filter what it removes, summed over all orders: n! times its Shapley value in the game of removed documents.

    The Harsanyi dividend of a set of filters is its joint count with the sign
    of inclusion and exclusion; its members share it evenly.
    """
    dividend = lambda t: -((-1) ** t.bit_count()) * factorial(n) // t.bit_count()
    return _sums(joint, [{t: dividend(t) for t in range(1 << n) if t >> i & 1} for i in range(n)])


def by_order(joint: DataFrame, names: list[str]) -> DataFrame:
    """One row for every part, order of the filters and step, as the columns of ``audit``; read from the joint counts alone."""
    n = len(names)
    sets = joint.select(
        "part", "joint", *[survivors(c, n).alias(to) for c, to in (("joint", "_left"), ("joint_good", "_good"), ("joint_toxic", "_toxic"))],
        unique_failures("joint", n).alias("_unique"), shapley_totals("joint", n).alias("_shapley"),
    )
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(names))), " ")
    rows = sets.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bit = lambda at: f"shiftleft(1, instr('{''.join(names)}', substr(filter_order, {at}, 1)) - 1)"
    rows = rows.withColumn("_before", F.expr(f"aggregate(filter(sequence(1, {n}), i -> i < step), 0, (m, i) -> m + {bit('i')})")).withColumn("_own", F.expr(bit("step")))
    at = F.expr(f"instr('{''.join(names)}', substr(filter_order, step, 1)) - 1")
    lost = lambda c: F.get(c, F.col("_before")) - F.get(c, F.col("_before") + F.col("_own"))
    return rows.select(
        "part", "filter_order", "step", F.get("_left", F.col("_before") + F.col("_own")).alias("kept"), lost("_left").alias("removed"), (F.get("joint", F.col("_own")) - lost("_left")).alias("redundant"),
        F.get("_unique", at).alias("unique_fails"), lost("_good").alias("good_lost"), lost("_toxic").alias("toxic_lost"), F.get("_shapley", at).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of five filters removes at each step of each of their 120 orders, by source.

    Filters A to D as in ``failures`` with its bounds; E drops a document whose
    text a smaller doc_id has anywhere in the table, whether that one is
    removed or not. Columns: part, filter_order, step and, counted within the
    part, kept (after the step), removed (by it), redundant (fail its filter,
    but went before), unique_fails (fail its filter only), good_lost and
    toxic_lost (removed here and labelled so), shapley (removed by its filter,
    summed over all orders).

    Nulls: an empty text, part '' (which it shares with empty sources), and no
    copy without a doc_id. Repeated rows count as often as they are there.
    Several labels of a doc_id: one that says good (toxic) is enough. An empty
    table gives no rows. Only doc_id, text and source and the labels' doc_id,
    quality and toxic are read, so other columns can't clash.
    """
    names = ["A", "B", "C", "D", "E"]
    rows = labelled(failures(docs), labels.select("doc_id", "quality", "toxic"))
    return by_order(joint_failures(with_copies(rows, names[:4]), names), names)


def op11_filter_interaction_audit(spark, sf_dir):
    """Every part, order and step; edge cases as in ``audit``."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
docs AS (
  SELECT t.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
    (CASE WHEN len(words) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END) ||
    (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) ||
    (CASE WHEN coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) THEN 'E' ELSE '' END) AS fails
  FROM texts t LEFT JOIN marks m ON t.doc_id = m.doc_id),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x),
fates AS (
  SELECT part, good, toxic, fails, filter_order, CASE WHEN fails = '' THEN 6 ELSE list_min(list_transform(string_split(fails, ''), lambda x: instr(filter_order, x))) END AS gone FROM docs, orders),
steps AS (
  SELECT part, filter_order, step, count(*) FILTER (WHERE gone > step) AS kept, count(*) FILTER (WHERE gone = step) AS removed,
    count(*) FILTER (WHERE gone < step AND contains(fails, filter_order[step])) AS redundant, count(*) FILTER (WHERE fails = filter_order[step]) AS unique_fails,
    count(*) FILTER (WHERE gone = step AND good) AS good_lost, count(*) FILTER (WHERE gone = step AND toxic) AS toxic_lost
  FROM fates, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
FROM steps
"""

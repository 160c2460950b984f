"""Temperature mixing of sources, with DataFrame operations only.

Source token shares p are raised to an exponent a in [0, 1] and normalised: a = 1 keeps the
corpus as it is, a = 0 serves all sources alike. The exponent is bisected to meet a target:

* `entropy`: the weights' entropy is that share of the largest possible one (log of the number
  of sources), if the corpus has less; or
* `repetition`: the exponent is the smallest at which no source is read more than so many
  times.

The budget is the least number of tokens at which every source is read at least once, so no
document is lost; it can be set instead. A source's tokens are then drawn as block
permutations: documents are dealt to blocks by hash, every pass over the source orders its
blocks anew, and passes go on until the source's share of the budget is spent, so a document
is read again only after all others of its source. The drawn rows get a place in the mixture
that spreads each source evenly over it.

The bisection runs inside the query over one row that holds the source totals, which grows
with the number of sources, not of documents. Documents only ever meet in blocks of about
`block_tokens` tokens, and a source's blocks are summed in 4,096 cells before one row for each cell
meets in its running sum, so a source with a third of all rows is no single task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millwright.session import staged, table

#: Halvings of the exponent's interval.
STEPS = 40
#: The largest place in a mixture.
LAST = 0.999999999
#: Hexadecimal digits that tell the cells of a source's blocks: 4,096 of them.
CELL = 3


def word_count(text: Column) -> Column:
    """Words of a text, the tokens of a mixture: runs of characters but space and \\t-\\r."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def draw(*parts: Column) -> Column:
    """A hash in hexadecimal; equal in every SQL engine with MD5."""
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))


def exponent(shares: str, repetition: float | None, entropy: float | None) -> str:
    """SQL for the exponent, given the name of an array of positive shares."""
    power = f"transform({shares}, p -> power(p, mid))"
    if repetition is not None:  # read of source i, with the largest exactly once: p_i^(mid - 1) over the least of these
        reads = f"transform({shares}, p -> power(p, mid - 1))"
        enough = f"array_max({reads}) / array_min({reads}) <= {float(repetition)!r}D"
        return _bisected(enough, keep_high=True)
    spread = f"aggregate({power}, 0D, (s, w) -> s + w, s -> aggregate({power}, 0D, (h, w) -> h - w / s * ln(w / s)))"
    return _bisected(f"{spread} >= {float(entropy)!r}D * ln(size({shares}))", keep_high=False)


def _bisected(test: str, keep_high: bool) -> str:
    """Bisects [0, 1]: the smallest value that passes (keep_high) or the largest."""
    body = test.replace("mid", "((acc.lo + acc.hi) / 2)")
    mid = "(acc.lo + acc.hi) / 2"
    passed, failed = (f"named_struct('lo', acc.lo, 'hi', {mid})", f"named_struct('lo', {mid}, 'hi', acc.hi)") if keep_high else (f"named_struct('lo', {mid}, 'hi', acc.hi)", f"named_struct('lo', acc.lo, 'hi', {mid})")
    return f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (acc, i) -> CASE WHEN {body} THEN {passed} ELSE {failed} END, acc -> acc.{'hi' if keep_high else 'lo'})"


def source_weights(totals: DataFrame, repetition: float | None = 2.0, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """source, tokens, weight, budget (tokens to draw) of every source with tokens.

    `totals` has source and tokens. Weights sum to one. Sources without tokens have none."""
    if (repetition is None) == (entropy is None):
        raise ValueError("give either a repetition limit or a target entropy")
    held = totals.where("tokens > 0").groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "tokens"))).alias("all"), F.sum("tokens").alias("total"))
    shared = held.select("all", "total", F.expr("transform(all, s -> s.tokens / total)").alias("shares"))
    powered = shared.select("*", F.round(F.expr(exponent("shares", repetition, entropy)), 9).alias("a"))
    weighed = powered.select("*", F.expr("transform(shares, p -> power(p, a))").alias("w"))
    normed = weighed.select("*", F.expr("aggregate(w, 0D, (s, x) -> s + x)").alias("norm"))
    # The least budget that reads every source once: the largest of tokens / weight.
    least = F.expr("array_max(transform(all, (s, i) -> s.tokens / (w[i] / norm)))")
    spent = normed.select("*", (F.lit(float(budget)) if budget else least).alias("spend"))
    rows = spent.select(F.posexplode("all").alias("i", "s"), "w", "norm", "spend")
    weight = F.col("w")[F.col("i")] / F.col("norm")
    return rows.select(F.col("s.source").alias("source"), F.col("s.tokens").alias("tokens"), F.round(weight, 9).alias("weight"), F.round(weight * F.col("spend")).cast("long").alias("budget"))


def drawn(units: DataFrame, weights: DataFrame, block_tokens: int = 1 << 17, seed: int = 0) -> DataFrame:
    """Every drawing of a unit: the columns of `units` (row, source, tokens, ...) with `pass`
    (0 for the first), `start` (tokens of its source drawn before it) and `place` in [0, 1).

    A unit is drawn in a pass if it starts before the budget ends; one without tokens, or
    whose source has no tokens at all, is drawn in the first pass."""
    key, size = F.col("row"), F.greatest(F.lit(1), F.col("all_tokens"))
    plan = weights.select("source", F.col("tokens").alias("all_tokens"), "budget")
    known = units.join(plan, "source", "left").select(*units.columns, F.coalesce("all_tokens", F.lit(0)).alias("all_tokens"), F.coalesce("budget", F.lit(0)).alias("budget"))
    number = F.conv(F.substring(draw(F.lit(f"block{seed}"), key), 1, 8), 16, 10).cast("long")
    dealt = known.withColumn("block", F.pmod(number, F.ceil(size / F.lit(block_tokens)).cast("long")))
    sums = staged(dealt.groupBy("source", "block").agg(F.sum("tokens").alias("size"), F.max("all_tokens").alias("all_tokens"), F.max("budget").alias("budget")), "mixing-blocks")
    last = F.greatest(F.lit(0), F.ceil(F.col("budget") / size).cast("int") - 1)
    # Blocks are ordered by a hash; those with one start of it are a cell, and cells are summed first.
    passes = sums.select("*", F.explode(F.sequence(F.lit(0), last)).alias("pass")).withColumn("at", draw(F.lit(f"pass{seed}"), F.col("pass"), F.col("block"))).withColumn("cell", F.substring("at", 1, CELL))
    cells = passes.groupBy("source", "pass", "cell").agg(F.sum("size").alias("cell_size"))
    earlier = F.sum("cell_size").over(Window.partitionBy("source", "pass").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("source", "pass", "cell", F.coalesce(earlier, F.lit(0)).alias("first"))
    ordered = Window.partitionBy("source", "pass", "cell").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, -1)
    inside = passes.withColumn("inside", F.coalesce(F.sum("size").over(ordered), F.lit(0))).join(cells, ["source", "pass", "cell"])
    begin = inside.select("source", "block", "pass", "budget", "all_tokens", (F.col("pass") * F.col("all_tokens") + F.col("first") + F.col("inside")).alias("begin"))
    begin = begin.where((F.col("begin") < F.col("budget")) | (F.col("pass") == 0))
    each = dealt.drop("budget", "all_tokens").join(begin, ["source", "block"])
    inside = Window.partitionBy("source", "block", "pass").orderBy(draw(F.lit(f"row{seed}"), F.col("pass"), key), "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("start", (F.col("begin") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).cast("long"))
    placed = placed.where((F.col("start") < F.col("budget")) | (F.col("pass") == 0))
    return placed.withColumn("place", F.least(F.lit(LAST), F.col("start") / F.greatest(F.col("budget"), size))).select(*units.columns, "pass", "start", "place")


def drawings(docs: DataFrame, text: str = "text", repetition: float | None = 2.0, entropy: float | None = None, budget: int | None = None, block_tokens: int = 1 << 17, seed: int = 0) -> DataFrame:
    """Every drawing of the equal rows of `docs`: doc_id, digest, source, copies, tokens (of
    all copies), pass, start, place."""
    rows = docs.select("doc_id", F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), word_count(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    units = rows.groupBy("doc_id", "digest", "source").agg(F.count("*").cast("int").alias("copies"), F.sum("tokens").alias("tokens"))
    units = staged(units.withColumn("row", F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", "source")), "mixing-rows")
    weights = staged(source_weights(units.groupBy("source").agg(F.sum("tokens").alias("tokens")), repetition, entropy, budget), "mixing-weights")
    return drawn(units, weights, block_tokens, seed).drop("row")


def mixture(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """doc_id, source, tokens, pass, copy, start, place of every drawing of a row of `docs`.

    A null source is the source ''; a null text has no tokens. Equal rows (copy 0, 1, ...) are
    drawn together; no rows give none."""
    one = F.col("tokens") / F.col("copies")
    each = drawings(docs, text, **options).select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    return each.select("doc_id", "source", one.cast("long").alias("tokens"), "pass", "copy", (F.col("start") + F.col("copy") * one).cast("long").alias("start"), "place")


def mixed(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of `docs` themselves, each as often as the mixture draws it; columns as in
    `docs`. With the default budget every row comes at least once."""
    plan = drawings(docs.select("doc_id", text, "source"), text, **options)
    times = staged(plan.groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("source").alias("__source")).agg(F.count("*").cast("int").alias("__times")), "mixing-times")
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.md5(F.coalesce(docs[text], F.lit(""))) == F.col("__digest")) & (F.coalesce(docs["source"].cast("string"), F.lit("")) == F.col("__source"))
    again = docs.join(times, same).withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return again.select(*(F.col(c) for c in docs.columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed so that no source is read more than twice and none is lost."""
    return mixture(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP10_SQL = rf"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, md5(coalesce(text, '')) AS digest, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS tokens FROM documents),
units AS (
  SELECT doc_id, digest, source, count(*) AS copies, sum(tokens)::BIGINT AS tokens,
         concat_ws('|', coalesce(doc_id::VARCHAR, ''), digest, source) AS row_ FROM rows_ GROUP BY doc_id, digest, source),
totals AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM units GROUP BY source HAVING sum(tokens) > 0),
shares AS (SELECT list(tokens / (SELECT sum(tokens) FROM totals) ORDER BY source) AS ps FROM totals),
bisect(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN reads <= 2.0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN reads <= 2.0 THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT i, lo, hi, list_max(list_transform(ps, lambda p: power(p, (lo + hi) / 2 - 1))) / list_min(list_transform(ps, lambda p: power(p, (lo + hi) / 2 - 1))) AS reads FROM bisect, shares WHERE i < {STEPS})),
a AS (SELECT round(hi, 9) AS a FROM bisect WHERE i = {STEPS}),
w AS (SELECT source, tokens, power(tokens / (SELECT sum(tokens) FROM totals), (SELECT a FROM a)) AS w FROM totals),
normed AS (SELECT source, tokens, w / (SELECT sum(w) FROM w) AS weight FROM w),
budgets AS (SELECT source, tokens AS all_tokens, round(weight * (SELECT max(tokens / weight) FROM normed))::BIGINT AS budget FROM normed),
known AS (SELECT u.*, coalesce(all_tokens, 0) AS all_tokens, coalesce(budget, 0) AS budget FROM units u LEFT JOIN budgets USING (source)),
dealt AS (SELECT *, ('0x' || substr(md5('block0|' || row_), 1, 8))::BIGINT % ceil(greatest(1, all_tokens) / {1 << 17})::BIGINT AS block FROM known),
blocks AS (SELECT source, block, sum(tokens)::BIGINT AS size, max(all_tokens) AS all_tokens, max(budget) AS budget FROM dealt GROUP BY source, block),
passes AS (SELECT *, unnest(range(0, greatest(1, ceil(budget / greatest(1, all_tokens))::BIGINT))) AS pass FROM blocks),
begins AS (
  SELECT source, block, pass, budget, pass * all_tokens + coalesce(sum(size) OVER (PARTITION BY source, pass ORDER BY md5('pass0|' || pass || '|' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_ FROM passes),
placed AS (
  SELECT d.*, b.pass, begin_ + coalesce(sum(d.tokens) OVER (PARTITION BY d.source, d.block, b.pass ORDER BY md5('row0|' || b.pass || '|' || row_), row_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_
  FROM dealt d JOIN begins b ON d.source = b.source AND d.block = b.block AND (begin_ < b.budget OR b.pass = 0)),
each AS (SELECT *, unnest(range(0, copies)) AS copy FROM placed WHERE start_ < budget OR pass = 0)
SELECT doc_id, source, (tokens / copies)::BIGINT AS tokens, pass::INT AS pass, copy::INT AS copy, (start_ + copy * (tokens / copies))::BIGINT AS start,
       least({LAST}, start_::DOUBLE / greatest(budget, all_tokens, 1)) AS place
FROM each
"""

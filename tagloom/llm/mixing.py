r"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Leaves are (domain, lang, source).  A token budget goes down the tree: a node's share is dealt to its children by their weights,
but none gets more than its leaves can give in max_epochs epochs; what a child cannot take goes to its siblings by weight, and only
what all of them cannot take is missing at their parent, whose siblings take it.  Dealing is exact integer arithmetic: children in
order of capacity by weight are filled until the rest can take its weighted share; shares are rounded down.

A leaf gives whole epochs first.  From the next epoch, in an order seeded by epoch, it gives the longest prefix of documents within
its remaining tokens.  A leaf of any size is spread over tasks: documents fall into 16 ** DIGITS ranges of the order's hash, whose
token sums tell the bucket in which the prefix ends; only that one is sorted, inside itself.  What goes to all tasks is one row a
leaf.  Texts are read for their tokens once; sizes and places are worked out on a table of (doc_id, leaf, tokens).

Tokens are runs of characters that are not white space.  Edge cases: null lang or source are empty strings; null texts have no
tokens; a leaf with weight 0 gets nothing; documents without tokens come with their place in the order; equal doc_ids are ordered by
tokens, and repeated rows each count; extra columns may have any name; with no tokens at all, nothing is selected; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, materialize, table
from .ngram_join import _small

LEVELS = ("__domain", "__lang", "__source")
#: Production parameters: share of all tokens (in percent), epochs, seed, and weights.
PERCENT, EPOCHS, SEED = 80, 2, 7
DIGITS = 3  # hexadecimal digits of a bucket

_BLANK = r"\x20\x09-\x0D"


def n_tokens(text: Column) -> Column:
    """Runs of characters other than white space."""
    w = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{_BLANK}]+", "w")
    return F.length(F.regexp_replace(w, f"[{_BLANK}]+", "")).cast("long")


def domain(source: Column) -> Column:
    """The default domain of a source: one of four, by its MD5."""
    return F.concat(F.lit("domain"), F.floor((F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(source), 1, 1)) - 1) / 4).cast("string"))


#: Default integer weights of domains, languages and sources.
WEIGHTS = {"__domain": "1", "__lang": "CASE __lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END", "__source": "1"}


def deal(children: DataFrame, parent: list[str], weight: str, name: str) -> DataFrame:
    """children (with budget, of their parent, and cap) get their own budget instead: exact water filling by weight."""
    by = [F.col(c) for c in parent] or [F.lit(0)]
    big = lambda c: F.col(c).cast("decimal(38,0)")
    rows = children.withColumn("w", F.expr(weight).cast("long"))
    rows = rows.withColumn("ratio", F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w")))
    order = Window.partitionBy(*by).orderBy(F.col("ratio").asc_nulls_last(), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    rows = rows.withColumn("weights", F.sum("w").over(Window.partitionBy(*by)) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    full = (F.col("w") > 0) & (big("cap") * big("weights") <= big("w") * big("left"))
    rows = rows.withColumn("full", F.min(full.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # All that are not filled share what is left before the first of them.
    first = lambda c: F.max(F.when(F.col("full") == 0, F.struct(-F.col("place"), F.col(c)))).over(Window.partitionBy(*by))[c]
    rows = rows.withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("rest", first("left")).withColumn("over", first("weights"))
    share = F.when(F.col("over") > 0, F.expr("CAST(CAST(w AS DECIMAL(38,0)) * CAST(rest AS DECIMAL(38,0)) DIV CAST(over AS DECIMAL(38,0)) AS LONG)")).otherwise(F.lit(0))
    rows = rows.withColumn("budget", F.when(F.col("full") == 1, F.col("cap")).otherwise(F.greatest(share, F.lit(0))).cast("long"))
    return rows.select(*parent, name, "cap", "budget")


def budgets(leaves: DataFrame, percent: int = PERCENT, epochs: int = EPOCHS, weights: dict[str, str] = WEIGHTS) -> DataFrame:
    """leaves (LEVELS, tokens) get budget: tokens to give."""
    caps = leaves.withColumn("cap", F.col("tokens") * epochs)
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)).cast("decimal(38,0)") * percent / 100).cast("long").alias("budget"))
    now, parent = total, []
    for name in LEVELS:
        children = caps.groupBy(*parent, name).agg(F.sum("cap").alias("cap"))
        # One row a node of the tree.
        rows = children.join(now, parent) if parent else children.crossJoin(F.broadcast(now))
        now = deal(rows, parent, weights[name], name).drop("cap")
        parent = [*parent, name]
    return leaves.join(now, parent)


def measured(docs: DataFrame, domain_of=domain) -> DataFrame:
    """row (a struct of all columns of docs, whatever their names), doc_id, LEVELS and __n_tokens."""
    source = F.coalesce(F.col("source"), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(row, "doc_id", domain_of(source).alias("__domain"), F.coalesce("lang", F.lit("")).alias("__lang"), source.alias("__source"), n_tokens(F.col("text")).alias("__n_tokens"))


def _place(rows: DataFrame, seed: int) -> DataFrame:
    """rows of leaves with __whole get the key of the next epoch's order, and its bucket."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("__whole") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return rows.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, DIGITS))


def plan_of(sizes: DataFrame, percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED, weights: dict[str, str] = WEIGHTS) -> DataFrame:
    """One row a leaf that gives something: __whole epochs, __rest tokens of the next one, the bucket __edge in which these end, and __base tokens before it."""
    leaves = sizes.groupBy(*LEVELS).agg(F.sum("__n_tokens").alias("tokens"))
    plan = budgets(materialize(leaves, "leaves"), percent, epochs, weights)
    plan = plan.select(*LEVELS, F.expr("CASE WHEN tokens > 0 THEN budget DIV tokens ELSE 0 END").alias("__whole"), F.expr("CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END").alias("__rest"))
    plan = _small(materialize(plan.where("__whole > 0 OR __rest > 0"), "plan"))
    # Sums of at most 16 ** DIGITS buckets a leaf.
    rows = _place(sizes.join(plan.where("__rest > 0"), list(LEVELS)), seed)
    sums = rows.groupBy(*LEVELS, "__bucket").agg(F.sum("__n_tokens").alias("n"), F.max("__rest").alias("rest"))
    done = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("__bucket"))
    edge = sums.select(*LEVELS, F.col("__bucket").alias("__edge"), (done - F.col("n")).alias("__base"), done.alias("done"), "rest").where("__base <= rest AND rest < done")
    return _small(materialize(plan.join(edge.drop("done", "rest"), list(LEVELS), "left"), "edges"))


def pick(rows: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """The measured rows that the plan takes, and __copies. Only rows in the bucket of a leaf's edge are sorted."""
    rows = _place(rows.join(plan, list(LEVELS)), seed)
    clear = rows.where("__edge IS NULL OR __bucket <> __edge").withColumn("__in", F.expr("coalesce(__bucket < __edge, false)"))
    order = Window.partitionBy(*LEVELS).orderBy("__key", "doc_id", "__n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where("__bucket = __edge").withColumn("__in", F.col("__base") + F.sum("__n_tokens").over(order) <= F.col("__rest"))
    both = clear.unionByName(edge).withColumn("__copies", F.col("__whole") + F.col("__in").cast("long"))
    return both.where("__copies > 0").select("row", *LEVELS, "__n_tokens", "__copies")


def sizes_of(docs: DataFrame, domain_of=domain) -> DataFrame:
    """doc_id, LEVELS and __n_tokens of every row, written: texts are read for their tokens once."""
    return materialize(measured(docs, domain_of).select("doc_id", *LEVELS, "__n_tokens"), "sizes")


def mix(docs: DataFrame, percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED, weights: dict[str, str] = WEIGHTS, domain_of=domain) -> DataFrame:
    """The selected documents: all columns, LEVELS, __n_tokens and __copies (epochs that give it); with _ after a name that docs has itself."""
    plan = plan_of(sizes_of(docs, domain_of), percent, epochs, seed, weights)
    own = [*LEVELS, "__n_tokens", "__copies"]
    return pick(measured(docs, domain_of), plan, seed).select("row.*", *(F.col(c).alias(x) for c, x in zip(own, free(docs.columns, *own), strict=True)))


def select_mixture(docs: DataFrame) -> DataFrame:
    """One epoch at most of every document, its own columns only."""
    return pick(measured(docs), plan_of(sizes_of(docs), epochs=1)).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sizes_of(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    rows = pick(sizes.withColumn("row", F.struct("doc_id")), plan_of(sizes))
    return rows.select("row.doc_id", F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), F.col("__n_tokens").alias("n_tokens"), F.col("__copies").alias("copies"))


def _level(k: int) -> str:
    names = ["domain", "lang", "source"]
    parent, name = names[:k], names[k]
    weight = WEIGHTS[f"__{name}"].replace("__", "")
    p = ", ".join(parent)
    over = f"PARTITION BY {p} " if p else ""
    match = f"USING ({p})" if p else "ON true"
    lead = f"{p}, " if p else ""
    return f"""
c{k} AS (SELECT x.*, budget FROM (SELECT {lead}{name}, sum(cap)::HUGEINT AS cap, ({weight})::HUGEINT AS w FROM leaf GROUP BY {lead}{name}) x JOIN l{k} {match}),
o{k} AS (SELECT *, row_number() OVER o AS place, budget - coalesce(sum(cap) OVER b, 0)::HUGEINT AS rest, (sum(w) OVER ({over}) - coalesce(sum(w) OVER b, 0))::HUGEINT AS ws FROM c{k}
  WINDOW o AS ({over}ORDER BY CASE WHEN w > 0 THEN cap::DOUBLE / w::DOUBLE END NULLS LAST, {name}), b AS ({over}ORDER BY CASE WHEN w > 0 THEN cap::DOUBLE / w::DOUBLE END NULLS LAST, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g{k} AS (SELECT *, min(CASE WHEN w > 0 AND cap * ws <= w * rest THEN 1 ELSE 0 END) OVER ({over}ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM o{k}),
h{k} AS (SELECT *, arg_min(rest, place) FILTER (filled = 0) OVER ({over}) AS r, arg_min(ws, place) FILTER (filled = 0) OVER ({over}) AS v FROM g{k}),
l{k + 1} AS (SELECT {lead}{name}, CASE WHEN filled = 1 THEN cap WHEN v > 0 THEN greatest(w * r // v, 0) ELSE 0 END AS budget FROM h{k})"""


ORACLE_SQL = {
    "op7_mixing": rf"""
WITH d AS (SELECT doc_id, 'domain' || CAST((strpos('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) // 4 AS VARCHAR) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^{_BLANK}]+', 'w', 'g'), '[{_BLANK}]+', '', 'g')) AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {EPOCHS} AS cap FROM d GROUP BY ALL),
l0 AS (SELECT (sum(n_tokens)::HUGEINT * {PERCENT}) // 100 AS budget FROM d),{_level(0)},{_level(1)},{_level(2)},
p AS (SELECT domain, lang, source, budget // tokens AS whole, budget % tokens AS rest FROM leaf JOIN l3 USING (domain, lang, source) WHERE tokens > 0),
q AS (SELECT d.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || CAST(whole + 1 AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done FROM d JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN rest > 0 AND done <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM q WHERE whole + CASE WHEN rest > 0 AND done <= rest THEN 1 ELSE 0 END > 0"""
}

"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

A token budget runs down a tree of levels (domain, language, source). At each node it is divided among the children by
weight, no child getting more than its own subtree can supply; what a child cannot take goes to its siblings, and only
what the whole subtree cannot take has gone, one level higher, to the ancestors' siblings. Each leaf then takes whole
epochs of its documents and, of one further epoch in a seeded order, the prefix that fits the rest of its budget.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratum.llm.columns import col, opened, whole
from stratum.llm.scratch import documents, settle

LEVELS = ("domain", "lang", "source")
#: Weights of the default tree: by level, a name's weight among its siblings; names not listed weigh 1.
WEIGHTS = {"lang": {"en": 6.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def word_count(text: Column) -> Column:
    """White-space separated words, and at least one token for any document."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return F.greatest(F.lit(1), F.size(words)).cast("long")


def source_domain(source: Column, domains: int = 4) -> Column:
    """The source's number modulo ``domains``: the documents table has no domain column of its own."""
    return F.concat(F.lit("d"), F.pmod(F.coalesce(F.regexp_extract(source, r"(\d{1,9})", 1).try_cast("long"), F.lit(0)), F.lit(domains)))


def _weight(level: str, weights: dict) -> Column:
    named = F.from_json(F.lit(json.dumps(weights.get(level, {}))), F.lit("map<string,double>"))
    return F.coalesce(F.try_element_at(named, F.col(level)), F.lit(1.0))


def leaf_budgets(leaves: DataFrame, total: Column | int | float, levels=LEVELS, weights: dict = WEIGHTS) -> DataFrame:
    """leaves (levels, cap) with a whole number of tokens ``budget`` <= cap for each, floor of the divided total.

    Siblings fill like vessels: with the caps sorted by cap / weight, a child is full exactly if its ratio is at most
    the level that the rest would reach without it.
    """
    out = leaves.withColumn("_given", F.lit(total).cast("double"))
    for i, level in enumerate(levels):
        parents = list(levels[:i])
        node = out.groupBy(*parents, level).agg(F.sum("cap").cast("double").alias("_cap"), F.first("_given").alias("_given")).withColumn("_w", _weight(level, weights))
        node = node.filter("_w > 0")
        rank = W.partitionBy(*(parents or [F.lit(0)])).orderBy(F.col("_cap") / F.col("_w"), level)
        before, after = rank.rowsBetween(W.unboundedPreceding, -1), rank.rowsBetween(0, W.unboundedFollowing)
        family = W.partitionBy(*(parents or [F.lit(0)]))
        node = node.withColumn("_level", F.greatest(F.lit(0.0), F.col("_given") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
        node = node.withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_w"))
        node = node.withColumn("_share", F.max(F.when(~F.col("_full"), F.col("_level"))).over(family) * F.col("_w"))
        node = node.select(*parents, level, F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_share")).alias("_next"))
        keys = [*parents, level]
        joined = out.alias("o").join(node.alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
        out = joined.select(*[F.col(f"o.{c}") for c in leaves.columns], F.col("n._next").alias("_given"))
    return out.withColumn("budget", F.floor(F.col("_given") + 1e-6).cast("long")).drop("_given")


def epoch_order(seed: int, epoch: Column, id_: Column) -> Column:
    """A document's place in the epoch's order: an MD5, the same in any SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit(""))))


def default_tree(source: Column | None = None, lang: Column | None = None) -> dict[str, Column]:
    """Level name -> its value, for tables with lang and source columns."""
    source = F.col("source") if source is None else source
    return {"domain": source_domain(source), "lang": F.col("lang") if lang is None else lang, "source": source}


def _taken(docs: DataFrame, row: Column, levels: dict[str, Column], tokens: Column, id_: Column, total_share: float, weights: dict, max_epochs: int, seed: int, rows_per_bucket: int) -> DataFrame:
    """(row, epoch, budget): one row for each epoch that a row of docs is taken in; its columns travel inside ``row``."""
    names = [f"level{i}" for i in range(len(levels))]
    weights = {n: weights.get(k, {}) for n, k in zip(names, levels, strict=True)}
    hashed = [col(f.name) for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())]
    base = docs.select(row, *[c.alias(n) for n, c in zip(names, levels.values(), strict=True)], tokens.alias("tokens"), id_.alias("id"), F.xxhash64(*hashed).alias("tie"))
    stats = settle(base.groupBy(*names).agg(F.sum("tokens").alias("supply"), F.count("*").alias("rows")), "leaves")
    total = (stats.agg(F.sum("supply")).first()[0] or 0) * total_share
    leaves = stats.withColumn("cap", F.col("supply") * max_epochs)
    leaves = leaf_budgets(leaves, total, tuple(names), weights)
    leaves = settle(
        leaves.withColumn("_whole", F.least(F.expr("budget div supply"), F.lit(max_epochs)))
        .withColumn("_rest", F.when(F.col("_whole") < max_epochs, F.col("budget") - F.col("_whole") * F.col("supply")).otherwise(0))
        .withColumn("_buckets", F.least(F.lit(65536), F.ceil(F.col("rows") / rows_per_bucket)).cast("long"))
        .withColumn("_leaf", F.xxhash64(*names)),
        "budgets",
    )
    # Levels are made anew as join keys, so both sides are exchanged and a leaf with very many rows may be split.
    side = leaves.select(*[F.col(k).alias(f"_{k}") for k in names], "_leaf", "budget", "_whole", "_rest", "_buckets")
    rows = base.join(side, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names])
    rows = rows.withColumn("_order", F.concat(epoch_order(seed, F.col("_whole"), F.col("id")), F.hex("tie")))
    rows = rows.withColumn("_bucket", F.expr("shiftright(cast(conv(substring(_order, 1, 8), 16, 10) as bigint) * _buckets, 32)"))

    narrow = rows.filter("_rest > 0").select("_leaf", "_bucket", "_order", "tokens", "_rest")
    sums = narrow.groupBy("_leaf", "_bucket").agg(F.sum("tokens").alias("_n"), F.first("_rest").alias("_rest"))
    upto = F.sum("_n").over(W.partitionBy("_leaf").orderBy("_bucket"))
    cut = sums.withColumn("_upto", upto).filter("_upto > _rest").groupBy("_leaf").agg(F.min("_bucket").alias("_cut"), F.min_by(F.col("_upto") - F.col("_n"), "_bucket").alias("_base"))
    cut = settle(cut, "cuts")
    inside = narrow.join(cut.withColumnRenamed("_leaf", "_l"), (F.col("_leaf") == F.col("_l")) & (F.col("_bucket") == F.col("_cut")))
    run = F.sum("tokens").over(W.partitionBy("_leaf").orderBy("_order").rangeBetween(W.unboundedPreceding, 0))
    last = inside.withColumn("_run", F.col("_base") + run).filter("_run <= _rest").groupBy("_leaf").agg(F.max("_order").alias("_last"))
    edge = settle(cut.join(last, "_leaf", "left").select(F.col("_leaf").alias("_l"), "_cut", F.coalesce("_last", F.lit("")).alias("_last")), "edges")

    took = rows.join(edge, F.col("_leaf") == F.col("_l"), "left")
    part = F.col("_cut").isNull() | (F.col("_bucket") < F.col("_cut")) | ((F.col("_bucket") == F.col("_cut")) & (F.col("_order") <= F.col("_last")))
    part = (F.col("_rest") > 0) & part
    epochs = F.col("_whole") + F.when(part, 1).otherwise(0)
    took = took.withColumn("_epochs", epochs.cast("int")).filter("_epochs > 0")
    return took.select("row", F.explode(F.sequence(F.lit(0), F.col("_epochs") - 1)).alias("epoch"), "budget")


def mix(docs: DataFrame, levels: dict[str, Column], tokens: Column, total_share: float = 0.8, weights: dict = WEIGHTS, max_epochs: int = 2, seed: int = 11, id_col: str = "doc_id", rows_per_bucket: int = 256, columns: bool = True) -> DataFrame:
    """docs' columns, one row for each epoch a document is taken in, with ``epoch`` (from 0) and ``budget`` (its leaf's).

    ``levels`` maps the tree's levels, from the root on, to values of docs' rows, and ``tokens`` is positive. The total is
    total_share of all tokens. A leaf supplies max_epochs times its tokens at most. The partial epoch takes a document if
    all documents up to and with it, in the epoch's order, fit the budget that whole epochs leave. Null levels are levels
    of their own; rows that share an id (or have none) are ordered by a hash of the whole row, and only rows equal in
    every column are taken or left together. An empty table gives an empty result. Columns of any name pass unchanged;
    only ``epoch`` and ``budget`` replace columns of these names, or with ``columns`` false aren't added at all.

    Running sums are taken per bucket of the seeded order, then inside the one bucket per leaf that the budget cuts:
    no window holds a leaf. The join to the leaves is left to the planner, which splits a hot leaf.
    """
    row = whole(docs, ("epoch", "budget") if columns else ())
    out = _taken(docs, row, levels, tokens, col(id_col), total_share, weights, max_epochs, seed, rows_per_bucket)
    return opened(out, *([F.col("epoch"), F.col("budget")] if columns else []))


def op9_mixing(spark, sf_dir):
    narrow = documents(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in default_tree().items()], word_count(F.col("text")).alias("tokens"))
    return mix(settle(narrow, "mix-rows"), {k: F.col(k) for k in LEVELS}, F.col("tokens"))


def _level_sql(i: int) -> str:
    parents, level = LEVELS[:i], LEVELS[i]
    keys = [*parents, level]
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    weight = " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in WEIGHTS.get(level, {}).items())
    weight = f"CASE {weight} ELSE 1.0 END" if weight else "1.0"
    cols = ", ".join(keys)
    return f"""
    n{i} AS (SELECT {cols}, sum(cap)::DOUBLE AS c, first(given) AS given, ({weight})::DOUBLE AS w FROM g{i} GROUP BY {cols}),
    l{i} AS (SELECT *, greatest(0, given - coalesce(sum(c) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
             FROM n{i} WINDOW o AS ({part} ORDER BY c / w, {level})),
    f{i} AS (SELECT *, CASE WHEN c <= lev * w THEN c ELSE w * max(CASE WHEN c > lev * w THEN lev END) OVER ({part}) END AS nxt FROM l{i}),
    g{i + 1} AS (SELECT g{i}.* EXCLUDE (given), nxt AS given FROM g{i} JOIN f{i} ON {" AND ".join(f"g{i}.{k} IS NOT DISTINCT FROM f{i}.{k}" for k in keys)}),"""


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, 'd' || (coalesce(try_cast(nullif(regexp_extract(source, '(\\d{{1,9}})', 1), '') AS BIGINT), 0) % 4) AS domain, lang, source,
         greatest(1, len(string_split_regex(regexp_replace(coalesce(text, ''), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '[\\x20\\x09-\\x0D]+')))::BIGINT AS tokens
  FROM documents),
s AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS supply, 2 * sum(tokens)::BIGINT AS cap FROM d GROUP BY ALL),
g0 AS (SELECT *, (SELECT sum(tokens) FROM d)::DOUBLE * 0.8 AS given FROM s),
{"".join(_level_sql(i) for i in range(3))}
b AS (SELECT *, least(budget // supply, 2) AS whole FROM (SELECT *, floor(given + 1e-6)::BIGINT AS budget FROM g3)),
r AS (SELECT d.*, b.budget, b.whole, CASE WHEN b.whole < 2 THEN b.budget - b.whole * b.supply ELSE 0 END AS rest,
             md5('11:' || b.whole || ':' || coalesce(doc_id::VARCHAR, '')) AS o
      FROM d JOIN b ON {" AND ".join(f"d.{k} IS NOT DISTINCT FROM b.{k}" for k in LEVELS)}),
t AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY o) AS run FROM r),
e AS (SELECT *, whole + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END AS epochs FROM t)
SELECT doc_id, domain, lang, source, tokens, unnest(range(epochs))::INTEGER AS epoch, budget FROM e WHERE epochs > 0
"""

"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Leaves are (domain, language, source).  A node's weight is its share among its siblings; leaves' capacities (tokens
times epochs allowed) add up the tree.  From the root down, each node pours its budget over its children by weight; a
child never gets more than its capacity, and what it cannot take goes to its siblings by weight.  So a shortage is made
up by siblings first, and only what a whole subtree cannot take reaches its ancestors' other children.

A leaf's budget is read as whole epochs and a last, partial one: rows in the order of a hash of seed, epoch and row,
up to the row in which the budget ends, which gives its first tokens only.  The place where the budget ends is found
from sums by hash slot, digit by digit: DEPTH times the slot in which it ends is split into 64.  Only the rows of the
last slot, a 262,144th of the leaf, are ordered one by one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import WORD, durable, pick

_LEVELS = ("domain", "lang", "source")
#: Bits of the hash that a step of the search for a budget's end takes, and steps.
DIGIT, DEPTH = 6, 3


def _pour(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Give each node (parent columns, child, weight, capacity, budget of its parent) its share of the budget.

    With children by capacity over weight, those that fill up form a prefix; the rest share what is left by weight.
    Shares are whole tokens that add up exactly: each is the difference of two rounded running sums.
    """
    fill = Window.partitionBy(*parent).orderBy((F.col("capacity") / F.col("weight")).asc(), F.col(child).asc())
    upto, beyond = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    level, zero = Window.partitionBy(*parent), F.lit(0).cast("long")
    nodes = nodes.withColumn("left", F.greatest(F.col("budget") - F.coalesce(F.sum("capacity").over(upto), zero), zero))
    nodes = nodes.withColumn("full", F.col("capacity") * F.sum("weight").over(beyond) <= F.col("left") * F.col("weight"))
    nodes = nodes.withColumn("spent", F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(level), zero))
    nodes = nodes.withColumn("rest", F.greatest(F.col("budget") - F.col("spent"), zero))
    nodes = nodes.withColumn("share", F.when(F.col("full"), zero).otherwise(F.col("weight")))
    nodes = nodes.withColumn("shares", F.sum("share").over(level))
    nodes = nodes.withColumn("run", F.sum("share").over(fill.rowsBetween(Window.unboundedPreceding, 0)))
    given = F.expr("if(full, capacity, rest * run div shares - rest * (run - share) div shares)")
    return nodes.withColumn("given", given).drop("left", "full", "spent", "rest", "share", "shares", "run", "budget")


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], budget: int | Column, epochs: int) -> DataFrame:
    """domain, lang, source, tokens, budget for leaves (domain, lang, source, tokens).

    weights maps each level to whole positive weights by name; a name without one weighs as the level's "*", else 1.
    Weight 0 leaves a node out.
    """

    def weigh(level: str) -> Column:
        own = weights.get(level, {})
        out = F.lit(int(own.get("*", 1)))
        for name, w in own.items():
            out = F.when(F.col(level) == name, int(w)).otherwise(out) if name != "*" else out
        return out.cast("long")

    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    for level in _LEVELS:
        leaves = leaves.filter(weigh(level) > 0)
    top = budget if isinstance(budget, Column) else F.lit(int(budget)).cast("long")
    given = leaves.groupBy().agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).select(top.cast("long").alias("budget"))
    for depth, level in enumerate(_LEVELS):
        above, keys = list(_LEVELS[:depth]), list(_LEVELS[: depth + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weigh(level))
        nodes = nodes.join(given, above) if above else nodes.join(given, F.lit(True))
        given = _pour(nodes, above or [F.lit(0)], level).select(*keys, F.col("given").alias("budget"))
    return leaves.select(*_LEVELS, "tokens").join(given, list(_LEVELS))


def _slot(step: int) -> Column:
    """The slot of a row after so many steps: the first digits of its hash."""
    return F.shiftright("hash", 32 - DIGIT * step)


def _at_end(mixed: DataFrame, step: int) -> DataFrame:
    """The rows of the slot in which their leaf's budget ends."""
    return mixed.filter(_slot(step) == F.col("end_slot"))


def mix(
    docs: DataFrame,
    domain: Column,
    weights: Mapping[str, Mapping[str, int]],
    budget: int | Column,
    epochs: int = 1,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """Per row: id_col, sig, domain, lang, source, n_tokens, epochs (whole ones), partial (tokens of the last epoch).

    A row's tokens are its words.  domain is a column over lang and source; budget may be a column over `tokens`, the
    sum of all rows.  A row is used epochs * n_tokens + partial tokens; over a leaf these add up to its budget.  Null
    lang, source or domain read as ''; a null text has no tokens; rows are ordered by md5 of seed and id, then sig, a
    hash of the row, and rows equal in both share their place.
    """
    rows = pick(docs, id=id_col, text=text_col, lang=lang_col, source=source_col)
    rows = rows.select(
        F.col("id").cast("long"),
        F.xxhash64("id", "text", "lang", "source").alias("sig"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )
    rows = durable(rows.withColumn("domain", F.coalesce(domain.cast("string"), F.lit(""))))
    leaves = rows.groupBy(*_LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = leaf_budgets(leaves, weights, budget, epochs).withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0))
    plan = durable(plan.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")).select(*_LEVELS, "whole", "rest"))
    mixed = rows.join(plan, list(_LEVELS), "left").fillna({"whole": 0, "rest": 0})
    mixed = mixed.withColumn("place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    mixed = mixed.withColumn("hash", F.conv(F.substring("place", 1, 8), 16, 10).cast("long"))
    before = Window.partitionBy(*_LEVELS).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    ends = None
    for step in range(1, DEPTH + 1):
        inside = mixed.withColumn("sofar", F.lit(0).cast("long")) if ends is None else _at_end(mixed.join(ends, list(_LEVELS)), step - 1)
        sums = inside.withColumn("slot", _slot(step)).groupBy(*_LEVELS, "rest", "sofar", "slot").agg(F.sum("n_tokens").alias("n"))
        sums = sums.withColumn("sofar", F.col("sofar") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        ends = durable(sums.filter("sofar < rest and sofar + n >= rest").select(*_LEVELS, F.col("slot").alias("end_slot"), "sofar"))
    mixed = mixed.join(ends, list(_LEVELS), "left").withColumn("slot", _slot(DEPTH))
    at_end = _at_end(mixed, DEPTH)
    order = Window.partitionBy(*_LEVELS).orderBy("place", "sig").rowsBetween(Window.unboundedPreceding, -1)
    taken = at_end.withColumn("sofar", F.col("sofar") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    taken = taken.withColumn("partial", F.greatest(F.lit(0), F.least("n_tokens", F.col("rest") - F.col("sofar"))))
    others = mixed.filter(~F.coalesce(F.col("slot") == F.col("end_slot"), F.lit(False)))
    others = others.withColumn("partial", F.when(F.col("slot") < F.col("end_slot"), F.col("n_tokens")).otherwise(0))
    out = ["id", "sig", *_LEVELS, "n_tokens", F.col("whole").alias("epochs"), F.col("partial").cast("long").alias("partial")]
    return taken.select(*out).unionByName(others.select(*out)).withColumnRenamed("id", id_col)

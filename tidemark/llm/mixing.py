"""Mixing sources to target weights, by hierarchical budgeting. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

BIG = "decimal(38,0)"


def words(text: Column) -> Column:
    """Words of the whole text: runs of other than the characters 9 to 13 and 32. 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _shared_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``got`` for each node: its part of ``budget``, which its parent has, by ``weight`` and at most ``cap``.

    What a node can't take goes to its siblings by their weights: with the nodes in order of cap / weight, those are
    full whose cap is at most their part of what the earlier ones leave. Tokens that division leaves over go to the
    largest remainders. As a node's cap is the sum of what is below it, only what all siblings together can't take
    is missing here, and the parent's siblings have got it already.
    """
    all_ = Window.partitionBy(*parent)
    order = all_.orderBy(F.col("cap") / F.col("weight"), name)
    big = lambda c: c.cast(BIG)
    nodes = nodes.withColumn("budget", F.least("budget", F.sum("cap").over(all_)))
    nodes = nodes.withColumn("before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    nodes = nodes.withColumn("left", F.col("budget") - F.coalesce("before", F.lit(0)))
    nodes = nodes.withColumn("from_here", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    full = big(F.col("cap")) * big(F.col("from_here")) <= big(F.col("left")) * big(F.col("weight"))
    nodes = nodes.withColumn("full", full)
    nodes = nodes.withColumn("pool", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(all_))
    nodes = nodes.withColumn("shares", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(all_))
    part = big(F.col("pool")) * big(F.col("weight"))
    nodes = nodes.withColumn("part", F.when(~F.col("full"), F.expr(f"cast(cast(pool as {BIG}) * cast(weight as {BIG}) div shares as bigint)")))
    nodes = nodes.withColumn("rest", F.when(~F.col("full"), part % big(F.col("shares"))))
    nodes = nodes.withColumn("over", F.col("pool") - F.coalesce(F.sum("part").over(all_), F.lit(0)))
    turn = F.row_number().over(all_.orderBy(F.col("full"), F.desc("rest"), name))
    nodes = nodes.withColumn("turn", turn)
    return nodes.withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise(F.col("part") + F.when(F.col("turn") <= F.col("over"), 1).otherwise(0)))


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, int], budget_percent: int = 100, max_epochs: int = 1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows that the mixture takes: ``doc_id``, a column for each level, ``n_tokens, full_epochs, part_tokens, taken_tokens``.

    ``levels`` are the columns of the tree from the root down, the last naming the leaves; a null is the node ``-``.
    ``weights`` gives integer weights by path ("web", "web/en", "web/en/src0"); a node without one weighs 1, a node with
    0 takes nothing. The budget is ``budget_percent`` of all tokens (words of whole texts), at most what ``max_epochs``
    passes over every leaf give. It goes down the tree by weights; what a node can't take its siblings take, and only
    then, one level up, their parent's siblings. A leaf takes as many whole epochs as fit, then a prefix, in tokens, of
    one more epoch, whose order is the MD5 of seed, epoch and identifier, then the identifier: the last document may be
    taken in part (``part_tokens < n_tokens``).

    Documents without words are never taken. A null identifier counts as the text ``-`` and comes last among equals.
    Rows that repeat an identifier follow each other. Texts of any length are read whole, for their number of words. An
    empty table gives an empty result; other columns are not read.
    """
    if any(w < 0 for w in weights.values()) or max_epochs < 1 or budget_percent < 0:
        raise ValueError("weights and budget must not be negative, max_epochs at least 1")
    spark, names = docs.sparkSession, list(levels)
    scratch = Scratch(spark, "mixing")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.coalesce(c.cast("string"), F.lit("-")).alias(n) for n, c in levels.items()), words(F.col(text_col)).alias("n_tokens"))
    rows = scratch.put(rows.where("n_tokens > 0"))
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map(F.lit(""), F.lit(1))
    weight = [F.coalesce(F.element_at(table, F.concat_ws("/", *names[: i + 1])), F.lit(1)).cast("long") for i in range(len(names))]
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    barred = reduce(lambda a, b: a | b, [w == 0 for w in weight])
    leaves = scratch.put(leaves.withColumn("cap", F.when(barred, 0).otherwise(F.col("tokens") * max_epochs)))
    total = leaves.agg(F.floor(F.sum(F.col("tokens").cast(BIG)) * budget_percent / 100).cast("long").alias("budget"))
    tree = total
    for i, name in enumerate(names):
        above, here = names[:i], names[: i + 1]
        nodes = leaves.groupBy(*here).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", F.greatest(weight[i], F.lit(1)))
        nodes = nodes.join(tree, above) if above else nodes.join(F.broadcast(tree), how="left")  # the tree is one row at the root
        tree = _shared_out(nodes, above, name).select(*here, F.col("got").alias("budget"), "tokens")
        tree = scratch.put(tree if i == len(names) - 1 else tree.drop("tokens"))
    state = tree.where("budget > 0").select(*names, F.expr("budget div tokens").alias("full_epochs"), (F.col("budget") % F.col("tokens")).alias("rest"))
    state = scratch.put(state)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    rows = rows.join(state, names).withColumn("key", key)
    # The place in an epoch where a leaf's prefix ends, to 2 and then to 4 digits of the key; no task adds up a leaf's documents.
    at = state.where("rest > 0").select(*names, F.lit("").alias("head"), F.lit(0).cast("long").alias("before"))
    for digits in (2, 4):
        here = rows.where("rest > 0").join(at, names).where(F.substring("key", 1, digits - 2) == F.col("head"))
        sums = here.groupBy(*names, "rest", "before", F.substring("key", 1, digits).alias("next")).agg(F.sum("n_tokens").alias("n"))
        run = F.sum("n").over(Window.partitionBy(*names).orderBy("next")) + F.col("before")
        sums = sums.withColumn("end", run).where((F.col("end") >= F.col("rest")) & (F.col("end") - F.col("n") < F.col("rest")))
        at = scratch.put(sums.select(*names, F.col("next").alias("head"), (F.col("end") - F.col("n")).alias("before")))
    rows = rows.join(at, names, "left").withColumn("side", F.when(F.col("head").isNull() | (F.substring("key", 1, 4) > F.col("head")), 1).when(F.substring("key", 1, 4) < F.col("head"), -1).otherwise(0))
    last = Window.partitionBy(*names).orderBy("key", F.col("doc_id").asc_nulls_last())
    edge = rows.where("side = 0").withColumn("start", F.sum("n_tokens").over(last.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens") + F.col("before"))
    edge = edge.withColumn("part_tokens", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("start")))).drop("start")
    out = rows.where("side <> 0").withColumn("part_tokens", F.when(F.col("side") < 0, F.col("n_tokens")).otherwise(0)).unionByName(edge)
    out = out.withColumn("taken_tokens", F.col("full_epochs") * F.col("n_tokens") + F.col("part_tokens"))
    return out.where("taken_tokens > 0").select("doc_id", *names, "n_tokens", "full_epochs", F.col("part_tokens").cast("long").alias("part_tokens"), "taken_tokens")

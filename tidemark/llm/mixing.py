"""Mixing sources to target weights: hierarchical budgeting over a domain-language-source tree.

A token budget runs down the tree. At every node it is shared among the children by
weight; a child that has less than its share (all its epochs used) gives the rest back to
its siblings, and only what a whole subtree cannot use goes further up, because each
node's capacity is known before its parent's budget is shared. Shares are integers that
add up exactly.

A leaf's documents are put into a seeded order, anew for each epoch; the leaf's quota is a
prefix of those epochs' tokens: whole epochs first, then documents of the next one until
the quota is full, the last one cut to its first words. The order is a hash, so the prefix
is found from the token sums of hash ranges, and only the one range that holds the cut is
sorted: no leaf, however large, meets in one task.

Tokens are runs of characters other than ASCII whitespace. Defined cases: null or empty
texts have no token and are never selected. A null domain, language or source is the empty
name. Weights are integers; a node without one has weight 1, and weight 0 (or below) takes
nothing. Repeated rows are documents of their own, side by side in the order. A budget over
all capacity is cut to it. Extra columns pass through, but one named epoch, n_tokens or
n_taken is replaced, and a level's name is added only where the table has no such column.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import P
from tidemark.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in a hash range, about.
RANGE_ROWS = 2048
BIG = "decimal(38,0)"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Each child's budget: the parent's ``budget`` by ``weight``, none above its ``cap``.

    In order of cap / weight the children that cannot use their share come first; the
    others divide what is left by weight, rounded on the running sum so that it adds up.
    """
    order = [F.col("cap") / F.col("weight"), F.col(name)]
    w = W.partitionBy(*parent).orderBy(*order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    d = (children.withColumn("rem", F.col("budget").cast(BIG) - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(BIG))
         .withColumn("rest", F.sum("weight").over(w.rowsBetween(0, W.unboundedFollowing)))
         .withColumn("full", F.col("cap").cast(BIG) * F.col("rest") <= F.col("weight") * F.col("rem")))
    d = d.withColumn("full", F.min(F.col("full").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1)
    open_ = W.partitionBy(*parent)
    d = (d.withColumn("left", F.max(F.when(~F.col("full"), F.col("rem"))).over(open_))
         .withColumn("open", F.max(F.when(~F.col("full"), F.col("rest"))).over(open_))
         .withColumn("run", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(w.rowsBetween(W.unboundedPreceding, 0))))
    whole = lambda x: F.expr(f"CAST(CAST(left AS decimal(38,0)) * ({x}) AS decimal(38,0)) div open")
    return (d.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(whole("run") - whole("run - weight")).cast("long"))
            .drop("rem", "rest", "full", "left", "open", "run"))


def quotas(leaves: DataFrame, levels: list[str], weights: dict[str, dict[tuple, int]], budget: int, max_epochs: int) -> DataFrame:
    """``leaves``: the level columns and tokens. Adds quota. ``weights[level]`` maps the
    path down to that level to its weight."""
    nodes = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    for k, level in enumerate(levels):
        path = levels[:k + 1]
        table = weights.get(level, {})
        weight = F.lit(1)
        for key, value in table.items():
            hit = F.lit(True)
            for c, v in zip(path[-len(key):], key):
                hit = hit & (F.col(c) == v)
            weight = F.when(hit, F.lit(int(value))).otherwise(weight)
        nodes = nodes.withColumn("w_" + level, weight.cast("long")).where((F.col("w_" + level) > 0) & (F.col("cap") > 0))
    tree = nodes.withColumn("root", F.lit(0))
    have = None
    for k, level in enumerate(levels):
        path, parent = ["root", *levels[:k + 1]], ["root", *levels[:k]]
        children = tree.groupBy(*path, F.col("w_" + level).alias("weight")).agg(F.sum("cap").alias("cap"))
        if have is None:
            whole = F.sum("cap").over(W.partitionBy("root"))
            children = children.withColumn("budget", F.least(F.lit(int(budget)).cast("long"), whole))
        else:
            children = children.join(have, parent)
        have = _share(children, parent, level).select(*path, "budget")
    return leaves.join(have.drop("root").withColumnRenamed("budget", "quota"), levels)


def plan(docs: DataFrame, levels: list[str], weights: dict[str, dict[tuple, int]], budget: int | None, share: float,
         max_epochs: int) -> DataFrame:
    """One row per leaf: tokens, docs, quota, and how it is met: whole epochs, the rest to take."""
    leaves = materialize(docs.groupBy(*levels).agg(F.sum(P + "tokens").alias("tokens"), F.count("*").alias("docs")), "leaves")
    if budget is None:
        total = leaves.agg(F.sum("tokens").alias("t")).first()["t"] or 0
        budget = int(total * share)
    q = quotas(leaves, levels, weights, budget, max_epochs)
    digits = F.greatest(F.lit(1), F.ceil(F.log(16.0, F.greatest(F.lit(1.0), F.col("docs") / RANGE_ROWS))).cast("int"))
    return materialize(q.where(F.col("quota") > 0).select(
        *levels, "tokens", "quota", F.expr("CAST(quota div tokens AS INT)").alias("epochs"),
        F.expr("quota % tokens").alias("take"), F.least(F.lit(12), digits).alias("digits")), "mix_plan")


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[tuple, int]], budget: int | None = None,
        share: float = 0.5, max_epochs: int = 3, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Selected documents: all columns of ``docs``, epoch (from 0), n_tokens and n_taken,
    with ``text_col`` cut to the first n_taken tokens where the quota ends inside it.

    ``levels``: the tree's levels from the top, each with the expression that names it.
    ``budget``: tokens in all; by default ``share`` of the tokens there are.
    """
    names = [P + k for k in levels]
    placed = docs.withColumns({P + k: F.coalesce(v.cast("string"), F.lit("")) for k, v in levels.items()})
    count = tokens(F.col(text_col))
    ids = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(P + "id")
    # texts are counted here once, and once more where they leave; everything between reads this narrow table
    narrow = materialize(placed.select(*names, ids, count.alias(P + "tokens")), "mix_tokens")
    todo = plan(narrow, names, {P + k: v for k, v in weights.items()}, budget, share, max_epochs)
    # one row per leaf: Spark broadcasts it if its written size is small, else joins by shuffle
    todo = todo.select(*names, *[F.col(c).alias(P + c) for c in ("epochs", "take", "digits")])
    epochs, take, cut, before, start = (F.col(P + c) for c in ("epochs", "take", "cut", "before", "start"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), epochs, F.col(P + "id")))
    ranged = F.expr(f"substr({P}order, 1, {P}digits)")
    sums = (narrow.join(todo, names).where((F.col(P + "tokens") > 0) & (take > 0)).withColumn(P + "order", order)
            .groupBy(*names, ranged.alias(P + "range"), P + "take").agg(F.sum(P + "tokens").alias("sum")))
    ahead = W.partitionBy(*names).orderBy(P + "range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn(P + "before", F.coalesce(F.sum("sum").over(ahead), F.lit(0)))
    cuts = sums.where((before < take) & (before + F.col("sum") >= take)).select(*names, F.col(P + "range").alias(P + "cut"), P + "before")
    todo = materialize(todo.join(cuts, names, "left"), "mix_todo")
    rows = placed.withColumn(P + "id", ids).join(todo, names).withColumn(P + "order", order).withColumn(P + "range", ranged)

    own = W.partitionBy(*names).orderBy(P + "order", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), P + "tokens")
    inside = rows.where(F.col(P + "range") == cut).withColumn(P + "tokens", count).where(F.col(P + "tokens") > 0).withColumn(
        P + "start", before + F.coalesce(F.sum(P + "tokens").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    n = F.col(P + "tokens")
    last = inside.where(start < take).withColumns({P + "taken": F.least(n, take - start), P + "epoch": epochs})
    last = last.withColumn(text_col, F.when(F.col(P + "taken") < n, first_tokens(F.col(text_col), F.col(P + "taken"))).otherwise(F.col(text_col)))
    # whole documents: once per whole epoch, and once more before the cut of the last one
    times = epochs + F.coalesce(F.col(P + "range") < cut, F.lit(False)).cast("int")
    whole = (rows.withColumn(P + "times", times).where(F.col(P + "times") > 0).withColumn(P + "tokens", count).where(F.col(P + "tokens") > 0)
             .withColumn(P + "taken", n).withColumn(P + "epoch", F.explode(F.sequence(F.lit(0), F.col(P + "times") - 1))))
    added = {"epoch": "epoch", "n_tokens": "tokens", "n_taken": "taken"}
    cols = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    cols += [F.col(n_).alias(k) for n_, k in zip(names, levels) if k not in docs.columns]
    cols += [F.col(P + v).alias(k) for k, v in added.items()]
    return whole.select(*cols).unionByName(last.select(*cols))


def first_tokens(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th token, its whitespace as it was."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")

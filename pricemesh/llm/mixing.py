"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree of domain, language and source. At every node the children share its budget in
proportion to their weights, but none takes more than it can supply (its tokens times max_epochs); what one cannot
take goes to its siblings, and only what all of them cannot take is missing from the parent's own supply and so goes
to the parent's siblings. This water-filling is solved in closed form: children ordered by supply per weight, the
saturated ones are a prefix of that order.

A leaf takes its budget from an endless sequence of epochs, each a seeded permutation of its documents: some whole
epochs, then the prefix of the next one that fits. The end of the prefix is found in two steps, first among 4,096
ranges of the permutation key, then among the rows of the one range that holds it, so a leaf with a third of all
rows is never sorted in one task. Documents are picked by comparing their key with the end of their leaf.

Null language or source counts as the empty name, null text as no tokens. Rows that share a doc_id share a key and are
taken together or not at all; rows without doc_id share one key. Texts without tokens cost nothing and ride along
with the prefix. Leaves without weight, or without tokens, get nothing. Columns of docs that
clash with a column of the result, or of the way to it, are dropped.
Texts of any length are counted whole, and an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pricemesh import staging

LEVELS = ("domain", "lang", "source")
#: White space, which parts tokens, and a token with the white space behind it.
SPACE = " \t\n\x0b\x0c\r"
TOKEN = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"
#: Hex digits of the key that name a range.
RANGE_DIGITS = 3


def _n_tokens(text: Column) -> Column:
    """Every token shrinks to one letter: regexp_count would hold all tokens of a text at once."""
    return F.length(F.ltrim(F.regexp_replace(text, TOKEN, "x"), F.lit(SPACE)))


def _weight(level: str, weights: Mapping[str, Mapping[str, int]], default: int) -> Column:
    known = weights.get(level, {})
    chosen = F.lit(default)
    for name, w in known.items():
        chosen = F.when(F.col(level) == name, F.lit(int(w))).otherwise(chosen)
    return chosen.cast("decimal(38,0)")


def _shared_out(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes (weight, supply, parent_share) with `share` of the parent's budget: min(supply, level * weight), filled up."""
    heir = F.col("weight") > 0
    by_fill = W.partitionBy(*parent).orderBy(
        (~heir).cast("int"), F.when(heir, F.col("supply").cast("double") / F.col("weight").cast("double")), "_name"
    )
    before, after = by_fill.rowsBetween(W.unboundedPreceding, -1), by_fill.rowsBetween(0, W.unboundedFollowing)
    filled = nodes.withColumn("_budget", F.col("parent_share").cast("decimal(38,0)")).select(
        "*",
        F.coalesce(F.sum("supply").over(before), F.lit(0)).cast("decimal(38,0)").alias("_before"),
        F.sum("weight").over(after).cast("decimal(38,0)").alias("_open"),
    )
    full = (F.col("weight") > 0) & (F.col("supply") * F.col("_open") <= (F.col("_budget") - F.col("_before")) * F.col("weight"))
    tested = filled.withColumn("_full", full)
    group = W.partitionBy(*parent)
    tested = tested.withColumns(
        {
            "_spent": F.coalesce(F.sum(F.when(F.col("_full"), F.col("supply"))).over(group), F.lit(0)),
            "_rest": F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group),
        }
    )
    share = (
        F.when(F.col("weight") <= 0, F.lit(0))
        .when(F.col("_full"), F.col("supply"))
        .otherwise(F.expr("least(supply, cast(greatest(0, (_budget - _spent)) * weight div _rest as decimal(38,0)))"))
    )
    return tested.withColumn("share", share.cast("decimal(38,0)")).drop("_budget", "_before", "_open", "_full", "_spent", "_rest")


def plan(
    leaves: DataFrame,
    budget: int,
    weights: Mapping[str, Mapping[str, int]],
    default_weight: int = 1,
    max_epochs: int = 4,
) -> DataFrame:
    """leaves (domain, lang, source, tokens) with target tokens, whole epochs and the rest for the next epoch.

    Weights are whole numbers by level and name. Shares are cut to whole tokens, so a node may stay a few tokens
    (fewer than it has children) below its budget.
    """
    supply = leaves.withColumn("supply", (F.col("tokens") * max_epochs).cast("decimal(38,0)"))
    level_table, parents = None, []
    for k, level in enumerate(LEVELS):
        path = list(LEVELS[: k + 1])
        nodes = supply.groupBy(*path).agg(F.sum("supply").cast("decimal(38,0)").alias("supply"))
        nodes = nodes.withColumns({"weight": _weight(level, weights, default_weight), "_name": F.col(level)})
        if level_table is None:
            nodes = nodes.withColumn("parent_share", F.lit(budget))
        else:
            nodes = nodes.join(level_table, parents)
        shared = _shared_out(nodes, parents)
        level_table = shared.select(*path, F.col("share").alias("parent_share"))
        parents = path
    target = leaves.join(level_table, list(LEVELS)).withColumn("target", F.col("parent_share").cast("bigint"))
    target = target.withColumn("full_epochs", F.expr("if(tokens > 0, target div tokens, 0)"))
    return target.select(
        *LEVELS, "tokens", "target", "full_epochs", (F.col("target") - F.col("full_epochs") * F.col("tokens")).alias("rest")
    )


def _key(seed: int) -> Column:
    """Place of a document in the permutation of its leaf's last epoch."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full_epochs").cast("string"), name))


def mix(
    docs: DataFrame,
    domain: Column,
    percent: int,
    weights: Mapping[str, Mapping[str, int]],
    default_weight: int = 1,
    max_epochs: int = 4,
    seed: int = 7,
    text: str = "text",
) -> DataFrame:
    """The picked rows of docs with domain, n_tokens and copies (how many epochs they appear in).

    The budget is `percent` of the tokens of docs, which has doc_id, lang and source.
    """
    kept = [c for c in docs.columns if c not in ("domain", "n_tokens", "copies", "full_epochs", "_lang", "_source", "_last", "_partial")]
    named = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumns(
        {
            "domain": F.coalesce(domain, F.lit("")),
            "_lang": F.coalesce(F.col("lang"), F.lit("")),
            "_source": F.coalesce(F.col("source"), F.lit("")),
            "n_tokens": F.coalesce(_n_tokens(F.col(f"`{text}`")), F.lit(0)).cast("bigint"),
        }
    )
    light = named.select("doc_id", "domain", F.col("_lang").alias("lang"), F.col("_source").alias("source"), "n_tokens")
    light = staging.written(light, "mix-tokens")
    leaves = light.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budget = (light.agg(F.sum("n_tokens")).first()[0] or 0) * percent // 100
    targets = staging.written(plan(leaves, budget, weights, default_weight, max_epochs), "mix-plan")

    keyed = light.join(targets.select(*LEVELS, "full_epochs", "rest"), list(LEVELS)).withColumn("key", _key(seed))
    keyed = keyed.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = keyed.groupBy(*LEVELS, "range", "rest").agg(F.sum("n_tokens").alias("held"))
    so_far = F.sum("held").over(W.partitionBy(*LEVELS).orderBy("range"))
    ends = ranges.withColumn("reach", so_far).where("reach > rest")
    first = ends.groupBy(*LEVELS).agg(F.min(F.struct("range", (F.col("reach") - F.col("held")).alias("before"))).alias("end"))
    split = staging.written(first.select(*LEVELS, F.col("end.range").alias("range"), F.col("end.before").alias("before")), "mix-ends")
    # Only the one range of each leaf in which its prefix ends is ordered row by row; equal keys count together.
    reach = F.col("before") + F.sum("n_tokens").over(W.partitionBy(*LEVELS, "range").orderBy("key"))
    inside = keyed.join(split, [*LEVELS, "range"]).withColumn("reach", reach).where("reach <= rest")
    last = inside.groupBy(*LEVELS).agg(F.max("key").alias("last_key"))
    cuts = (
        targets.join(split, list(LEVELS), "left")
        .join(last, list(LEVELS), "left")
        .select(
            F.col("domain"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), "full_epochs",
            F.when(F.col("rest") > 0, F.coalesce("last_key", "range")).otherwise("").alias("_last"),
        )
    )
    cuts = staging.written(cuts, "mix-cuts")
    picked = named.join(cuts, ["domain", "_lang", "_source"]).withColumn("_partial", (_key(seed) <= F.col("_last")).cast("bigint"))
    picked = picked.withColumn("copies", F.col("full_epochs") + F.col("_partial")).where("copies > 0")
    return picked.select(*[F.col(f"`{c}`") for c in kept], "domain", "n_tokens", "copies")

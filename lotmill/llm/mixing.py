"""Mixing sources to target weights.

Budgets are propagated down a tree of domains, languages and sources. What a source cannot supply within its
cap of repeats is offered to its siblings first, then further up. Each leaf fills its budget with whole epochs
and the token-prefix of one more epoch in seeded order.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotmill.operators.skew import ranked, running, skew_join, small_enough
from lotmill.session import cut

#: Weights and limits are summed as whole numbers, which add up to the same in any order: a weight counts in 1/UNIT of the largest one, or of up to half of it.
WHOLE, UNIT = "decimal(38,0)", 1e30
#: A share that misses a limit or a whole number of tokens by less than the rounding of doubles has reached it.
NEAR = 1 + 1e-14


def budgets(leaves: list[dict], total: float) -> dict[tuple, float]:
    """Tokens for each leaf. A leaf has ``path`` (domain, language, source), ``weight`` and ``limit``.

    A node's budget goes to its children by weight; children that reach their limit keep it and the rest is
    shared among the others. What a whole node cannot take is left to its parent, that is to nodes further away.
    This is the plain version, on lists; :func:`budgeted` does the same on tables of any size.
    """

    def node(under: list[dict], depth: int, amount: float) -> dict[tuple, float]:
        if depth == len(under[0]["path"]):
            return {under[0]["path"]: min(amount, under[0]["limit"])}
        kids: dict = {}
        for x in under:
            kids.setdefault(x["path"][depth], []).append(x)
        weight = {k: sum(x["weight"] for x in v) for k, v in kids.items()}
        limit = {k: sum(x["limit"] for x in v if x["weight"] > 0) for k, v in kids.items()}
        given, open_, rest = {}, {k for k in kids if weight[k] > 0}, min(amount, sum(limit.values()))
        while open_:
            whole = sum(weight[k] for k in open_)
            full = {k for k in open_ if rest * weight[k] / whole >= limit[k]}
            if not full:
                given |= {k: rest * weight[k] / whole for k in open_}
                break
            given |= {k: limit[k] for k in full}
            rest -= sum(limit[k] for k in full)
            open_ -= full
        return {p: b for k, v in kids.items() for p, b in node(v, depth + 1, given.get(k, 0.0)).items()}

    return node(leaves, 0, total) if leaves else {}


def _filled(kids: DataFrame, parent: list[str], key: str, few: bool) -> DataFrame:
    """``kids`` (``parent``, ``key``, weight, limit, amount of the parent) with ``given``: what each child gets of its parent's amount.

    Children are full in the order of limit to weight: one is if its share of what those before it leave reaches its limit.
    """
    w, cap = F.col("weight").cast("double"), F.col("limit").cast("double")
    laid = running(kids.withColumn("__ratio", cap / w), parent, [F.col("__ratio"), F.col(key)], ["weight", "limit"], totals=True)
    amount = F.least("amount", F.col("__all_limit").cast("double"))
    share = (amount - (F.col("__upto_limit") - F.col("limit")).cast("double")) * (w / (F.col("__all_weight") - F.col("__upto_weight") + F.col("weight")).cast("double"))
    level = laid.groupBy(*parent).agg(*(F.coalesce(F.max(F.when(share * NEAR >= cap, F.col(f"__upto_{c}"))), F.lit(0).cast(WHOLE)).alias(f"__full_{c}") for c in ("weight", "limit")))
    both = skew_join(laid, level, parent, F.col(key), is_small=few or None)
    share = (amount - F.col("__full_limit").cast("double")) * (w / (F.col("__all_weight") - F.col("__full_weight")).cast("double"))
    given = F.when(F.col("__upto_weight") <= F.col("__full_weight"), cap).otherwise(F.greatest(F.lit(0.0), F.least(cap, share)))
    out = both.select(*kids.columns, given.alias("given"))
    return out if few else cut(out)


def budgeted(leaves: DataFrame, path: list[str], total: float) -> DataFrame:
    """``leaves`` (``path``, weight > 0 and limit as whole numbers, other columns) with ``given``, as :func:`budgets`, level by level from the root."""
    above, few = None, small_enough(leaves)  # a node's row is no wider than a leaf's, so where leaves are few all tables here are small
    for depth, key in enumerate(path, 1):
        kids = leaves.groupBy(*path[:depth]).agg(F.sum("weight").alias("weight"), F.sum("limit").alias("limit")) if depth < len(path) else leaves
        if above is None:
            kids = kids.select("*", F.lit(0).alias("__root"), F.lit(float(total)).alias("amount"))
        else:
            kids = skew_join(kids, above.select(*path[: depth - 1], F.col("given").alias("amount")), path[: depth - 1], F.col(key), is_small=few or None)
        above = _filled(kids, path[: depth - 1] or ["__root"], key, few)
    return above.select(*leaves.columns, "given")


def _floor(c: Column) -> Column:
    """Whole tokens; what is a rounding error below a whole number is that number."""
    return F.floor(c * NEAR + 1e-9)


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(uses, shares) of a mixture.

    ``docs`` has (doc_id, source, lang, tokens) and may have ``domain``; ``targets`` (source, target_weight, max_repeat). Sources must be
    folded already. A leaf of the tree is the documents of one domain, language and source; a source's weight is
    shared among its leaves by the tokens they hold, so that they run short together. Null domains and languages are one each.
    ``total_tokens`` defaults to the tokens the listed sources hold once.

    uses: ``doc_id, source, uses, tokens`` for each document used at least once; uses never exceed max_repeat.
    shares: a row for each target: ``source, target_share, actual_share, available_tokens, budget_tokens, used_tokens,
    used_documents, short`` (true where the budget by weight could not be met within the cap).

    Null sources and sources that are not listed supply nothing. Documents without tokens are not used. Negative or
    null weights and repeats count as 0; of repeated targets the weights are summed and the largest cap holds.
    A budget ends inside a document at most: the document that crosses it is left out, so a leaf misses its
    budget by less than one document. Sources and leaves are tables: the tree is the same however many there are.
    """
    targets = targets.where("source is not null").groupBy("source").agg(F.sum(F.greatest(F.coalesce(F.col("target_weight").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("weight"), F.max(F.greatest(F.coalesce(F.col("max_repeat").cast("int"), F.lit(0)), F.lit(0))).alias("cap"))
    domain = F.coalesce(F.col("domain").cast("string"), F.lit("")) if "domain" in docs.columns else F.lit("")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.coalesce("lang", F.lit("")).alias("lang"), domain.alias("domain"), F.col("tokens").cast("bigint").alias("tokens"))
    docs, path = docs.where("tokens > 0 and source is not null"), ["domain", "lang", "source"]
    by_leaf = cut(docs.groupBy(*path).agg(F.sum("tokens").alias("size")))
    plan = cut(targets.join(by_leaf.groupBy("source").agg(F.sum("size").alias("available")), "source", "left").fillna(0, ["available"]))
    top, held = plan.agg(F.coalesce(F.max("weight"), F.lit(0.0)), F.coalesce(F.sum("available"), F.lit(0))).first()
    if not math.isfinite(top):
        raise ValueError("a target weight is not finite")
    scale, total = 2.0 ** (math.frexp(top)[1] - 1), held if total_tokens is None else total_tokens
    one, none = F.lit(1).cast(WHOLE), F.lit(0).cast(WHOLE)
    plan = plan.withColumn("units", F.when(F.col("weight") > 0, F.greatest((F.col("weight") / scale * UNIT).cast(WHOLE), one)).otherwise(none))
    units = plan.agg(F.sum("units")).first()[0]
    whole = float(Fraction(int(units or 0)) / Fraction(int(UNIT)) * Fraction(scale)) or 1.0

    leaf = skew_join(by_leaf, plan.where("units > 0").select("source", "units", "cap", "available"), ["source"], F.struct("domain", "lang"))
    weight = F.greatest((F.col("units").cast("double") * F.col("size") / F.col("available")).cast(WHOLE), one)
    leaf = budgeted(leaf.select(*path, "size", "cap", weight.alias("weight"), (F.col("size").cast("decimal(19,0)") * F.col("cap")).cast(WHOLE).alias("limit")), path, total)
    leaf = cut(leaf.select(*path, "size", "cap", "limit", "given"))
    budget = leaf.groupBy("source").agg(_floor(F.sum(F.col("given").cast("decimal(38,12)")).cast("double")).alias("budget"))
    leaf = leaf.select(*path, "size", "cap", F.least(_floor(F.col("given")), F.col("limit")).cast("bigint").alias("budget")).where("budget > 0")
    leaf = leaf.select(*path, F.expr("int(budget div size)").alias("epochs"), F.expr("budget % size").alias("open"), "cap")

    # full epochs use every document alike; the order of the last, partial one is drawn for it
    laid = skew_join(docs, leaf, path, F.col("doc_id"))
    partial = ranked(laid.where("open > 0 and epochs < cap"), path, F.xxhash64(F.lit(seed), "epochs", "doc_id"), ["doc_id"], F.col("tokens"))
    part = partial.where("__upto <= open").select("doc_id", "source", "tokens", (F.col("epochs") + 1).alias("uses"))
    rest = partial.where("__upto > open").select("doc_id", "source", "tokens", F.col("epochs").alias("uses"))
    full = laid.where("not (open > 0 and epochs < cap)").select("doc_id", "source", "tokens", F.col("epochs").alias("uses"))
    uses = part.unionByName(rest).unionByName(full).where("uses > 0").select("doc_id", "source", "uses", "tokens")

    used = uses.groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("used_tokens"), F.count(F.lit(1)).alias("used_documents"))
    zero, everything, share = F.lit(0).cast("bigint"), used.agg(F.sum("used_tokens")).scalar(), F.col("weight") / whole
    out = plan.join(budget, "source", "left").join(used, "source", "left")
    shares = out.select(
        "source",
        share.alias("target_share"),
        F.coalesce(F.col("used_tokens") / everything, F.lit(0.0)).alias("actual_share"),
        F.col("available").alias("available_tokens"),
        F.coalesce("budget", zero).alias("budget_tokens"),
        F.coalesce("used_tokens", zero).alias("used_tokens"),
        F.coalesce("used_documents", zero).alias("used_documents"),
        (share * total > F.col("available") * F.col("cap")).alias("short"),
    )
    return uses, shares

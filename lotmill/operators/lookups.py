"""Rule lookups: first match in order, interval validity with specificity, backward as-of, defaults.

Rule tables are small dimensions; each lookup broadcasts them only after counting them and falls back to a
plain join otherwise. Facts are never grouped as a whole: ties are settled by a window over the fact's own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmill.operators.skew import hot_keys, salted, skew_join, small_enough


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is seen to be within the bounds of rows and bytes."""
    return F.broadcast(df) if small_enough(df) else df


def first_match(facts: DataFrame, rules: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Left lookup of the rule that comes first in ``order`` for equal keys; rules with null keys match nothing."""
    best = rules.groupBy(*keys).agg(F.min_by(F.struct(*values), F.col(order)).alias("__r"))
    return facts.join(small(best), keys, "left").select(facts["*"], *(F.col(f"__r.{v}").alias(v) for v in values))


def criteria_asof(facts: DataFrame, rules: DataFrame, fact_id: list[str], at: str, axes: list[str], values: list[str]) -> DataFrame:
    """Left lookup of the most specific rule in force.

    A null axis of a rule matches anything, the validity from..to is inclusive and open where null. Of the rules that
    match a fact the one with most axes given wins, then the earlier in ``rule_order``. A fact without match keeps nulls,
    and a fact without ``at`` meets only rules that are open on both sides.

    For each set of axes that some rule gives (at most 2**axes) the rules of a combination of their values are one array in
    ``rule_order``, which the facts meet by equality: one row a fact, whatever the number of rules. The first rule of the array whose
    validity holds the fact's instant is taken in place. ``fact_id`` spreads the facts of a hot combination.
    """
    r = rules.select(*(F.col(a).alias(f"r_{a}") for a in axes), F.col("effective_from").alias("__from"), F.col("effective_to").alias("__to"), "rule_order", *values)
    shape = F.concat_ws("", *(F.when(F.col(f"r_{a}").isNull(), "0").otherwise("1") for a in axes)) if axes else F.lit("")
    r = r.withColumn("__shape", shape)
    shapes = sorted((x["__shape"] for x in r.select("__shape").distinct().collect()), key=lambda x: (-x.count("1"), x))  # at most 2**axes
    if few := small_enough(r):  # then so is each part of it
        r = r.coalesce(1)
    order = F.struct("rule_order", *values)
    out, picks = facts, []
    for i, x in enumerate(shapes):
        given = [a for a, bit in zip(axes, x, strict=True) if bit == "1"]
        mine = r.where(F.col("__shape") == x)
        one = F.struct(F.col("__from").alias("a"), F.col("__to").alias("z"), order.alias("v"))
        keys = [F.col(f"r_{a}").alias(a) for a in given] or [F.lit(1).alias("__any")]
        listed = mine.select(*keys, one.alias("o")).groupBy(*(given or ["__any"])).agg(F.array_sort(F.collect_list("o"), lambda p, q: F.when(p["v"]["rule_order"] < q["v"]["rule_order"], -1).when(p["v"]["rule_order"] > q["v"]["rule_order"], 1).otherwise(0)).alias(f"__l{i}"))
        if given:
            out = skew_join(out, listed, given, F.struct(*fact_id), "left", is_small=few)
        else:  # one row: the rules that give no axis
            one_row = listed.select(F.least(F.size(f"__l{i}"), F.lit(0)).alias("__any"), f"__l{i}")
            out = out.withColumn("__any", F.pmod(F.xxhash64(*fact_id), F.lit(1)).cast("int")).join(F.broadcast(one_row), "__any", "left").drop("__any")
        ok = F.filter(f"__l{i}", lambda o: (o["a"].isNull() | F.coalesce(o["a"] <= F.col(at), F.lit(False))) & (o["z"].isNull() | F.coalesce(o["z"] >= F.col(at), F.lit(False))))
        first = F.try_element_at(ok, F.lit(1))["v"]
        picks.append(F.struct(F.lit(len(given)).alias("specificity"), first.alias("v"), first.isNotNull().alias("hit")))
    if not picks:
        none = rules.select(*values).schema
        return out.select("*", *(F.lit(None).cast(none[v].dataType).alias(v) for v in values), F.lit(None).cast("int").alias("specificity"))
    # of equal specificity the earlier rule wins
    hits = F.filter(F.array(*picks), lambda p: p["hit"])
    best = F.try_element_at(F.array_sort(hits, lambda p, q: F.when(p["specificity"] > q["specificity"], -1).when(p["specificity"] < q["specificity"], 1).when(p["v"]["rule_order"] < q["v"]["rule_order"], -1).when(p["v"]["rule_order"] > q["v"]["rule_order"], 1).otherwise(0)), F.lit(1))
    out = out.withColumn("__best", best)
    return out.select(*facts.columns, *(F.col(f"__best.v.{v}").alias(v) for v in values), F.col("__best.specificity").alias("specificity"))


def asof_backward(facts: DataFrame, entries: DataFrame, by: list[str], fact_at: str, entry_at: str, values: list[str], tie: list[str], spread: Column, rows_per_group: int = 50_000) -> DataFrame:
    """Left as-of join: for each fact the entry of equal ``by`` with the greatest ``entry_at`` not after ``fact_at``.

    One union sorted by time and a last-value window: no range join and no growth with the number of entries per key.
    Entries tie by ``tie``, the greatest wins. Facts without an instant or an earlier entry get nulls; each fact stays one row.
    Facts of a hot key are spread over salts by ``spread`` (a column of facts) and the key's entries repeated for each.
    """
    cols, held = [c for c in facts.columns if c not in by], list(dict.fromkeys([*values, *tie]))
    facts, entries = salted(facts, entries, by, hot_keys(facts, by, rows_per_group), spread)
    by = [*by, "__salt"]
    f = facts.select(*by, F.col(fact_at).alias("__at"), F.lit(1).alias("__kind"), F.struct(*cols).alias("__f"), F.lit(None).cast(entries.select(F.struct(*held).alias("x")).schema["x"].dataType).alias("__e"))
    e = entries.where(F.col(entry_at).isNotNull()).select(*by, F.col(entry_at).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(f.schema["__f"].dataType).alias("__f"), F.struct(*held).alias("__e"))
    order = [F.col("__at"), F.col("__kind"), *(F.col(f"__e.{t}") for t in tie)]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = f.unionAll(e).withColumn("__hit", F.last("__e", ignorenulls=True).over(w)).where("__kind = 1")
    return out.select(*by[:-1], "__f.*", *(F.col(f"__hit.{v}").alias(v) for v in values))


def with_defaults(overrides: DataFrame, defaults: dict[str, float], key: str = "key", value: str = "value", by: str = "line") -> DataFrame:
    """``by, key, value``: every known key for every line, the line's own value or the default; unknown keys are dropped.

    ``overrides`` is long: (by, key, value), where a line without any override has one row with a null key.
    """
    known = overrides.sparkSession.createDataFrame(list(defaults.items()), f"{key} string, __d double")
    lines = overrides.select(by).distinct()
    wanted = lines.select(by, F.explode(F.array(*(F.lit(k) for k in defaults))).alias(key)).join(F.broadcast(known), key)
    own = overrides.where(F.col(key).isNotNull()).groupBy(by, key).agg(F.max(value).alias("__v"))
    return wanted.join(own, [by, key], "left").select(by, key, F.coalesce("__v", "__d").alias(value))


def missing_both_ways(a: DataFrame, b: DataFrame, key: Column, names: tuple[str, str]) -> DataFrame:
    """``missing_in, ref_key``: keys of one table that the other lacks, null keys aside. One grouped union instead of two anti joins."""
    both = a.select(key.alias("ref_key"), F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionAll(b.select(key.alias("ref_key"), F.lit(0), F.lit(1)))
    each = both.where("ref_key is not null").groupBy("ref_key").agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    return each.where("__a <> __b").select(F.when(F.col("__a") == 1, names[1]).otherwise(names[0]).alias("missing_in"), "ref_key")


def exists_on(facts: DataFrame, other: DataFrame, on: dict[str, Column], flag: str) -> DataFrame:
    """``facts`` with a boolean ``flag``: whether ``other`` has a row equal in all of ``on`` (names of fact columns)."""
    there = other.select(*(c.alias(k) for k, c in on.items())).distinct().withColumn(flag, F.lit(True))
    return facts.join(there, list(on), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))

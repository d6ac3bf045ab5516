"""User rules as column expressions, in four chains.

A rule looks at one mutation's columns and yields one outcome. Per-tenant
settings may switch it off or move it; they are joined as one map per tenant,
so a chain stays a narrow projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Chains in the order they run.
CHAINS = ["VALIDATE", "RECONCILE", "ENRICH", "ROUTE"]

_ADD, _MERGE, _OVERRIDE = "add", "merge", "override"


@dataclass(frozen=True)
class Rule:
    """``kind`` is reject, add, merge, override or route.

    ``applies`` limits the rule; ``value`` is the reason, the new value or
    the hints; an override also names the side that lost.
    """

    id: str
    chain: str
    priority: int
    kind: str
    value: Column
    applies: Column | None = None
    property: str | None = None
    losing_source: Column | None = None
    losing_value: Column | None = None


@dataclass
class _State:
    properties: Column
    hints: Column
    conflicts: list[Column] = field(default_factory=list)


def _settings(config: DataFrame) -> DataFrame:
    entry = F.struct("rule_id", F.struct("enabled", "priority_override"))
    return config.groupBy("model_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_rules"))


def active_rules(rules: list[Rule], config: DataFrame) -> DataFrame:
    """The rules a tenant runs, with their effective priority."""
    spark = config.sparkSession
    declared = spark.createDataFrame(
        [(r.id, r.chain, r.priority, i) for i, r in enumerate(rules)], "rule_id string, chain string, priority int, position int"
    )
    tenants = config.select("model_id").distinct()
    listed = F.array(*[F.lit(r.id) for r in rules])
    every = tenants.select("model_id", F.explode(listed).alias("rule_id"))
    joined = every.join(F.broadcast(declared), "rule_id").join(config, ["model_id", "rule_id"], "left")
    return joined.filter(F.coalesce("enabled", F.lit(True))).select(
        "model_id", "rule_id", "chain", F.coalesce("priority_override", "priority").alias("priority"), "position"
    )


def evaluate(mutations: DataFrame, rules: list[Rule], config: DataFrame | None = None,
             current_source: Column | None = None) -> DataFrame:
    """Run all chains; adds ``rejected_by``, ``reject_reason``, ``payload``
    (replaced), ``routing_hints`` and ``rule_conflicts``.

    Within a chain, higher priority first and declaration order on ties; the
    first rejection stops everything after it. ``current_source`` is a map of
    property to owning system, used to name the winner of an override.
    """
    rows = mutations
    if config is not None:
        rows = rows.join(_settings(config), "model_id", "left")

    def setting(rule: Rule, name: str, default: Column) -> Column:
        return default if config is None else F.coalesce(F.col("_rules")[rule.id][name], default)

    def fires(rule: Rule) -> Column:
        on = setting(rule, "enabled", F.lit(True))
        return F.coalesce(on & rule.applies, F.lit(False)) if rule.applies is not None else on

    def order(rule: Rule) -> Column:
        return -setting(rule, "priority_override", F.lit(rule.priority))

    entry = "struct<o:int,i:int,kind:string,prop:string,value:string,src:string,old:string,rule:string>"

    def entries(chain: str, kinds: list[str]) -> Column | None:
        picked = [
            F.when(
                fires(r),
                F.struct(
                    order(r).alias("o"), F.lit(i).alias("i"), F.lit(r.kind).alias("kind"), F.lit(r.property).alias("prop"),
                    r.value.cast("string").alias("value"),
                    (r.losing_source if r.losing_source is not None else F.lit(None)).cast("string").alias("src"),
                    (r.losing_value if r.losing_value is not None else F.lit(None)).cast("string").alias("old"),
                    F.lit(r.id).alias("rule"),
                ).cast(entry),
            )
            for i, r in enumerate(rules)
            if r.chain == chain and r.kind in kinds
        ]
        return F.array_sort(F.array_compact(F.array(*picked))) if picked else None

    none = F.lit(None).cast(entry)
    rejects = []
    for at, chain in enumerate(CHAINS):
        found = entries(chain, ["reject"])
        if found is not None:
            rejects.append(F.get(found, F.lit(0)))
    first = F.coalesce(*rejects, none) if rejects else none
    rows = rows.withColumn("_reject", first)

    properties = F.col("payload")
    clashes = []
    for chain in CHAINS:
        found = entries(chain, [_ADD, _MERGE, _OVERRIDE])
        if found is not None:
            properties = F.aggregate(found, properties, _put)
            clashes.append(F.filter(found, lambda e: e["kind"] == _OVERRIDE))
    hints = F.create_map().cast("map<string,string>")
    routes = [(i, r) for i, r in enumerate(rules) if r.kind == "route"]
    if routes:
        listed = F.array_sort(F.array_compact(F.array(*[
            F.when(fires(r), F.struct(F.lit(CHAINS.index(r.chain)).alias("c"), order(r).alias("o"), F.lit(i).alias("i"),
                                      F.map_entries(r.value).alias("m")))
            for i, r in routes
        ])))
        pairs = F.flatten(F.transform(listed, lambda e: e["m"]))
        hints = F.aggregate(pairs, hints, lambda acc, e: _set(acc, e["key"], e["value"]))

    clash = F.flatten(F.array(*clashes)) if clashes else F.array().cast(f"array<{entry}>")
    owner = current_source if current_source is not None else F.create_map().cast("map<string,string>")
    register = F.transform(
        clash,
        lambda e: F.struct(
            e["prop"].alias("property"),
            F.col("source_id").alias("losing_source_id"),
            e["src"].alias("losing_source"),
            e["old"].alias("losing_value"),
            F.when(e["src"] == F.col("source_system"), F.lit("")).otherwise(F.col("source_id")).alias("winning_source_id"),
            F.when(e["src"] == F.col("source_system"), F.coalesce(owner[e["prop"]], F.lit("")))
            .otherwise(F.col("source_system")).alias("winning_source"),
            e["value"].alias("winning_value"),
            e["rule"].alias("rule_id"),
        ),
    )
    passed = F.col("_reject").isNull()
    keep = [c for c in mutations.columns if c != "payload"]
    return rows.select(
        *keep,
        F.when(passed, properties).otherwise(F.col("payload")).alias("payload"),
        F.col("_reject.rule").alias("rejected_by"),
        F.col("_reject.value").alias("reject_reason"),
        F.when(passed, hints).otherwise(F.create_map().cast("map<string,string>")).alias("routing_hints"),
        F.when(passed, register).otherwise(F.filter(register, lambda e: F.lit(False))).alias("rule_conflicts"),
    )


def _set(props: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(props, lambda k, v: k != key), F.create_map(key, value))


def _put(props: Column, e: Column) -> Column:
    taken = (e["kind"] == _ADD) & F.map_contains_key(props, e["prop"])
    return F.when(taken, props).otherwise(_set(props, e["prop"], e["value"]))

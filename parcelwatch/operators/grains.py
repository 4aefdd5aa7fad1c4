"""Measures of all groupings the reports ask for, from one pass over the delivery facts.

A grain is a set of keys and the orders that count for it. Every fact becomes one row for each
grain it counts for, with the keys of that grain and none of the others; a grouping by order and
grain leaves a row per order and group, and its sums are the measures. Facts are dealt by order,
and making rows out of a row leaves them where they are, so the first grouping needs no shuffle;
the second one combines on the map side, and its shuffle carries a row per task and group.
`GROUPING SETS` would say the same, but its copies of rows forget how the facts are dealt, and
every one of them would be shuffled by order.

Each measure is kept for three ways of counting: `joined`, once for each joined row of items and
reviews; `items`, once for each item; `once`, each order and item once. All are sums over orders,
so the measures of some orders can be taken away and added again (`difference`).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwatch.functions import bands
from parcelwatch.operators.fanout import counted, group_measures, order_groups
from parcelwatch.params import Params

ROUTE = "rute_pengiriman"
KEYS = ("customer_state", ROUTE, "seller_id", "seller_state", "seller_city")


@dataclass(frozen=True)
class Grain:
    keys: tuple[str, ...]
    orders: str  # which orders count: see `counts_for`

    @property
    def needs(self) -> tuple[str, ...]:
        """The keys of the facts that the grain's keys come from."""
        return ("seller_state", "customer_state") if self.keys == (ROUTE,) else self.keys


GRAINS = {
    "state": Grain(("customer_state",), "delivered"),
    "route": Grain((ROUTE,), "delivered"),
    "seller": Grain(("seller_id",), "delivered"),
    "seller_processed": Grain(("seller_id",), "processed"),
    "seller_state": Grain(("seller_id", "seller_state"), "delivered"),
    "seller_place": Grain(("seller_id", "seller_state", "seller_city"), "moving"),
}

COUNTINGS = {"joined": {}, "items": {"reviews": False}, "once": {"per_order": True}}


def settings(params: Params) -> dict:
    """The parameters that grains depend on beside those of the tables, as plain values."""
    return {"moving": list(params.moving), "hub_state": params.hub_state}


def counts_for(orders: str, params: Params) -> Column:
    status, processed = F.col("order_status"), F.col("processed")
    delivered = status == params.delivered
    if orders == "moving":
        return status.isin(*params.moving) & processed
    return delivered & processed if orders == "processed" else delivered


def _key(name: str, params: Params) -> Column:
    if name == ROUTE:
        return bands.route(F.col("seller_state"), F.col("customer_state"), params)
    return F.col(name)


def compute(
    facts: DataFrame, grain: str, measures: Iterable[str], counting: str, params: Params
) -> DataFrame:
    """The keys and the named measures of one grain, straight from facts that have its keys."""
    wanted = GRAINS[grain]
    chosen = facts.filter(counts_for(wanted.orders, params))
    chosen = chosen.withColumns({k: _key(k, params) for k in wanted.keys})
    return group_measures(order_groups(chosen, wanted.keys, **COUNTINGS[counting]), wanted.keys, measures)


def all_grains(facts: DataFrame, params: Params) -> DataFrame:
    """Every grain: its name, its keys (others missing), `orders`, `late_orders` and all measures."""
    numbered = list(enumerate(GRAINS.items()))
    which = F.array(*[F.when(counts_for(grain.orders, params), F.lit(i)) for i, (_, grain) in numbered])
    names = F.array(*[F.lit(name) for name in GRAINS])
    keys = {k: [i for i, (_, grain) in numbered if k in grain.keys] for k in KEYS}
    own = [c for c in facts.columns if c not in KEYS]
    # copies differ in a number only until they are grouped: keys are not built and copied as arrays
    rows = facts.withColumn("which", F.explode(which)).filter("which IS NOT NULL").select(
        *own,
        F.element_at(names, F.col("which") + 1).alias("grain"),
        *[F.when(F.col("which").isin(*some), _key(k, params)).alias(k) for k, some in keys.items()],
    )
    measures = {
        f"{counting}_{name}": value
        for counting, how in COUNTINGS.items()
        for name, value in counted(**how).items()
    }
    late = F.max("late").alias("late_orders")
    groups = rows.groupBy("order_id", "grain", *KEYS).agg(late, *[v.alias(k) for k, v in measures.items()])
    return group_measures(groups, ("grain", *KEYS), ("orders", "late_orders", *measures))


def read(grains: DataFrame, grain: str, measures: Iterable[str], counting: str) -> DataFrame:
    """As `compute`, out of published grains."""
    columns = [
        F.col(m if m in ("orders", "late_orders") else f"{counting}_{m}").alias(m) for m in measures
    ]
    return grains.filter(F.col("grain") == grain).select(*GRAINS[grain].keys, *columns)


def difference(grains: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """Grains without the measures `gone` and with those `come`; groups without orders leave.

    An amount that all rows that are left lack is 0 then, not missing.
    """
    measures = [c for c in grains.columns if c not in ("grain", *KEYS)]
    minus = gone.select("grain", *KEYS, *[(-F.col(c)).alias(c) for c in measures])
    rows = grains.unionByName(minus).unionByName(come)
    sums = rows.groupBy("grain", *KEYS).agg(*[F.sum(c).cast("bigint").alias(c) for c in measures])
    # without a score left there is no sum of scores
    scored = {f"{c}_score_sum": F.when(F.col(f"{c}_scores") > 0, F.col(f"{c}_score_sum")) for c in COUNTINGS}
    return sums.filter("orders > 0").withColumns(scored).select(*grains.columns)

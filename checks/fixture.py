"""Marketplace raw tables derived from the shared test tables (see FIXTURES.md).

Only integer arithmetic on keys is used, so another engine derives the same rows. The
derivation is lazy: a query that needs two raw tables reads only what those two come from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR, DAY = 3600, 86400


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text(column: Column) -> Column:
    return column.cast("string")


def two_decimals(column: Column) -> Column:
    return F.floor(column * 100.0 + 0.5).cast("double") / 100.0


def null_if(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


def seconds_after(start: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("int"), start)


class RawTables(Mapping):
    """The eleven raw tables of one scale factor."""

    BUILDERS = (
        "orders",
        "order_items",
        "order_payments",
        "order_reviews",
        "customers",
        "products",
        "sellers",
        "geolocation",
        "mql",
        "closed_deals",
        "category_translation",
    )

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self.BUILDERS:
            raise KeyError(table)
        return self._once(table, getattr(self, f"_{table}"))

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Keep the lazy frame: describing it again would list and inspect files again."""
        if name not in self._frames:
            self._frames[name] = build()
        return self._frames[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.BUILDERS)

    def __len__(self) -> int:
        return len(self.BUILDERS)

    @cached_property
    def n_sellers(self) -> int:
        """Counted once: as a number in the plans it leaves their shuffles comparable."""
        return self._read("supplier").count()

    def _read(self, table: str) -> DataFrame:
        return self._once(f"{table}.parquet", lambda: read(self.spark, self.sf_dir, table))

    # --- places ---

    def _nation_states(self) -> DataFrame:
        nation = self._read("nation")
        return nation.select(
            "n_nationkey",
            F.when(F.col("n_nationkey") % 3 == 0, "SP").otherwise(F.col("n_name")).alias("state"),
        )

    def _located(self, table: str, nation_key: str) -> DataFrame:
        states = self._nation_states().withColumnRenamed("n_nationkey", nation_key)
        return self._read(table).join(states, nation_key, "left")

    def _customers(self) -> DataFrame:
        key = F.col("c_custkey")
        return self._located("customer", "c_nationkey").select(
            text(key).alias("customer_id"),
            F.concat(F.lit("person-"), text(key)).alias("customer_unique_id"),
            (key % 40).cast("int").alias("customer_zip_code_prefix"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("state").alias("customer_state"),
        )

    def _sellers(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self._located("supplier", "s_nationkey").select(
            text(key).alias("seller_id"),
            (key % 40).cast("int").alias("seller_zip_code_prefix"),
            F.col("s_name").alias("seller_city"),
            F.col("state").alias("seller_state"),
        )

    def _geolocation(self) -> DataFrame:
        key = F.col("c_custkey")
        return self._located("customer", "c_nationkey").select(
            (key % 40).cast("int").alias("geolocation_zip_code_prefix"),
            ((key * 37 % 1800) / F.lit(10.0) - 90.0).alias("geolocation_lat"),
            ((key * 53 % 3600) / F.lit(10.0) - 180.0).alias("geolocation_lng"),
            null_if(key % 17 == 0, F.col("c_mktsegment")).alias("geolocation_city"),
            F.col("state").alias("geolocation_state"),
        )

    # --- orders, items, reviews ---

    def _main_seller(self, order_key: Column) -> Column:
        """The seller of most items of an order, skewed to low seller keys."""
        sellers = F.lit(self.n_sellers)
        first, second = order_key % sellers, F.floor(order_key / sellers) % sellers
        return F.floor(first * second / sellers)

    def _timed_orders(self) -> DataFrame:
        """Orders with their moments as timestamps."""
        return self._once("timed orders", self._build_timed_orders)

    def _build_timed_orders(self) -> DataFrame:
        o = F.col("o_orderkey")
        # plain scans one after the other: Spark knows their sizes and broadcasts small ones
        customers = self._read("customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("customer_nation")
        )
        sellers = self._read("supplier").select(
            F.col("s_suppkey").alias("sk"), F.col("s_nationkey").alias("seller_nation")
        )
        states = self._nation_states()
        from_state = states.toDF("seller_nation", "main_seller_state")
        to_state = states.toDF("customer_nation", "customer_state")
        phase = o % 20
        status = (
            F.when(phase < 17, "delivered")
            .when(phase == 17, "shipped")
            .when(phase == 18, "processing")
            .otherwise("canceled")
        )
        purchase = F.col("o_orderdate")
        approval = HOUR * (1 + o % 30)
        processing = (F.col("sk") * 3 % 11) * DAY + (o * 7919) % DAY
        away = F.col("customer_state") != F.col("main_seller_state")
        transit = (
            (2 + o % 9) * DAY + (o * 104729) % DAY + F.when(away, 4 * DAY).otherwise(F.lit(0))
        )
        carrier = F.when(o % 103 == 0, purchase).otherwise(
            seconds_after(purchase, approval + processing)
        )
        return (
            self._read("orders")
            .withColumn("sk", self._main_seller(o))
            .join(customers, "o_custkey", "left")
            .join(to_state, "customer_nation", "left")
            .join(sellers, "sk", "left")
            .join(from_state, "seller_nation", "left")
            .select(
                o,
                "o_custkey",
                status.alias("status"),
                purchase.alias("purchase"),
                null_if(o % 101 == 0, seconds_after(purchase, approval)).alias("approved"),
                null_if(status.isin("processing", "canceled"), carrier).alias("carrier"),
                transit.alias("transit"),
                seconds_after(purchase, (14 + o % 8) * DAY).alias("estimated"),
            )
            .withColumn(
                "delivered",
                null_if(
                    (F.col("status") != "delivered") | (o % 97 == 0),
                    seconds_after(F.col("carrier"), F.col("transit")),
                ),
            )
        )

    def _orders(self) -> DataFrame:
        return self._timed_orders().select(
            text(F.col("o_orderkey")).alias("order_id"),
            text(F.col("o_custkey")).alias("customer_id"),
            F.col("status").alias("order_status"),
            text(F.col("purchase")).alias("order_purchase_timestamp"),
            text(F.col("approved")).alias("order_approved_at"),
            text(F.col("carrier")).alias("order_delivered_carrier_date"),
            text(F.col("delivered")).alias("order_delivered_customer_date"),
            text(F.col("estimated")).alias("order_estimated_delivery_date"),
        )

    def _order_items(self) -> DataFrame:
        sellers = F.lit(self.n_sellers)
        main = self._main_seller(F.col("l_orderkey"))
        seller = F.when(F.col("l_linenumber") >= 6, (main + 1) % sellers).otherwise(main)
        freight = F.col("l_quantity") * F.col("l_tax") * 10.0
        return self._read("lineitem").select(
            text(F.col("l_orderkey")).alias("order_id"),
            F.col("l_linenumber").cast("int").alias("order_item_id"),
            text(F.col("l_partkey")).alias("product_id"),
            text(seller.cast("bigint")).alias("seller_id"),
            text(F.col("l_shipdate")).alias("shipping_limit_date"),
            two_decimals(F.col("l_extendedprice")).alias("price"),
            two_decimals(freight).alias("freight_value"),
        )

    def _order_reviews(self) -> DataFrame:
        o = F.col("o_orderkey")
        late = F.coalesce(
            (F.col("status") == "delivered") & (F.col("delivered") > F.col("estimated")),
            F.lit(False),
        )
        score = (
            F.when(late & (o % 7 != 0), 1 + o % 3)
            .when(o % 17 == 0, F.lit(1))
            .otherwise(3 + o % 3)
        )
        kind = o % 9
        message = (
            F.when(kind == 0, "Produto chegou com ATRASO")
            .when(kind == 1, "demorou muito")
            .when(kind == 2, "Boa tarde, tudo certo")
            .when(kind == 3, "Great chocolate")
            .when(kind == 4, "Never arrived!")
            .when(kind != 5, "ok")
        )
        copies = F.when(o % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return (
            self._timed_orders()
            .filter(o % 10 < 8)
            .withColumn("copy", F.explode(copies))
            .select(
                text(o * 2 + F.col("copy")).alias("review_id"),
                text(o).alias("order_id"),
                score.cast("int").alias("review_score"),
                F.when(o % 4 != 0, "Avaliacao").alias("review_comment_title"),
                message.alias("review_comment_message"),
                text(F.col("estimated")).alias("review_creation_date"),
                text(seconds_after(F.col("estimated"), F.lit(2 * DAY))).alias(
                    "review_answer_timestamp"
                ),
            )
        )

    def _order_payments(self) -> DataFrame:
        o = F.col("o_orderkey")
        kinds = F.array(*map(F.lit, ("credit_card", "boleto", "voucher", "debit_card")))
        parts = F.when(o % 9 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        return (
            self._read("orders")
            .withColumn("part", F.explode(parts))
            .select(
                text(o).alias("order_id"),
                F.col("part").alias("payment_sequential"),
                F.element_at(kinds, (o % 4).cast("int") + 1).alias("payment_type"),
                (1 + o % 10).cast("int").alias("payment_installments"),
                two_decimals(F.col("o_totalprice")).alias("payment_value"),
            )
        )

    # --- supporting tables ---

    def _products(self) -> DataFrame:
        p, size = F.col("p_partkey"), F.col("p_size").cast("double")
        return self._read("part").select(
            text(p).alias("product_id"),
            null_if(p % 13 == 0, F.lower("p_type")).alias("product_category_name"),
            (size + 1).alias("product_name_lenght"),
            (size + 2).alias("product_description_lenght"),
            (size + 3).alias("product_photos_qty"),
            null_if(p % 11 == 0, size).alias("product_weight_g"),
            (size + 4).alias("product_length_cm"),
            (size + 5).alias("product_height_cm"),
            (size + 6).alias("product_width_cm"),
        )

    def _category_translation(self) -> DataFrame:
        """The part types, one without a translation and one left out."""
        kind = F.lower("p_type")
        return (
            self._read("part")
            .filter(kind != "standard")
            .select(kind.alias("product_category_name"))
            .distinct()
            .withColumn(
                "product_category_name_english",
                F.when(
                    F.col("product_category_name") != "promo",
                    F.concat(F.lit("en_"), "product_category_name"),
                ),
            )
        )

    def _signups(self) -> DataFrame:
        return self._read("events").filter(F.col("event_type") == "signup")

    def _mql(self) -> DataFrame:
        e = F.col("event_id")
        return self._signups().select(
            text(e).alias("mql_id"),
            F.date_format("ts", "yyyy-MM-dd").alias("first_contact_date"),
            null_if(e % 5 == 0, text(F.col("user_id"))).alias("landing_page_id"),
            null_if(e % 7 == 0, F.concat(F.lit("origin_"), text(e % 3))).alias("origin"),
        )

    def _closed_deals(self) -> DataFrame:
        e = F.col("event_id")
        sellers = F.lit(self.n_sellers)
        won = seconds_after(F.date_trunc("second", "ts").cast("timestamp_ntz"), F.lit(10 * DAY))

        def some(modulus: int, prefix: str) -> Column:
            return null_if(e % modulus == 0, F.concat(F.lit(prefix), text(e % 4)))

        return (
            self._signups()
            .filter(e % 4 == 0)
            .select(
                text(e).alias("mql_id"),
                text(e % sellers).alias("seller_id"),
                null_if(e % 12 == 0, text(won)).alias("won_date"),
                some(3, "segment_").alias("business_segment"),
                some(5, "lead_").alias("lead_type"),
                some(7, "profile_").alias("lead_behaviour_profile"),
                some(11, "business_").alias("business_type"),
                null_if(e % 9 == 0, (e % 100).cast("double")).alias(
                    "declared_product_catalog_size"
                ),
                null_if(e % 10 == 0, (e % 1000).cast("double")).alias("declared_monthly_revenue"),
            )
        )

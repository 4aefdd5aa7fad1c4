"""Small marketplaces written by hand, and ways to look at plans."""

from __future__ import annotations

from parcelwatch.schemas import RAW

SF = "/root/testdata/sf0.001"


def raw_table(spark, table, rows):
    """Rows are dicts; columns left out are missing."""
    columns = RAW[table]
    schema = ", ".join(f"{name} {kind}" for name, kind in columns.items())
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema)


def raw_tables(spark, **tables):
    return {name: raw_table(spark, name, tables.get(name, [])) for name in RAW}


def order(order_id, status="delivered", days=(0, 0, 1, 5, 10), customer="c1"):
    """An order whose moments lie the given days after 2018-01-01; None is missing."""

    def moment(day):
        return None if day is None else f"2018-01-{1 + day:02d} 00:00:00"

    names = (
        "order_purchase_timestamp",
        "order_approved_at",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    )
    moments = dict(zip(names, map(moment, days), strict=True))
    return {"order_id": order_id, "customer_id": customer, "order_status": status, **moments}


def item(order_id, seller="s1", price=10.0, freight=2.0, number=1, product="p1"):
    return {
        "order_id": order_id,
        "order_item_id": number,
        "product_id": product,
        "seller_id": seller,
        "price": price,
        "freight_value": freight,
    }


def review(order_id, score, message=None, review_id="r"):
    return {
        "review_id": review_id,
        "order_id": order_id,
        "review_score": score,
        "review_comment_message": message,
    }


def final_plan(df):
    """The plan that ran: adaptive plans, also those of subqueries, without their first drafts."""
    df.collect()
    kept, draft = [], None
    for line in planned(df).splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        if draft is not None and depth >= draft:
            continue
        draft = depth if "== Initial Plan ==" in line else None
        if draft is None:
            kept.append(line)
    return "\n".join(kept)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return [tuple(r) for r in df.collect()]


def column(df, name):
    return [r[name] for r in df.collect()]

"""The three market measurements per tag set and bucket.

A field that no message touched is NULL, never 0. All aggregates are combinable, so a hot tag set is reduced on the map side
and only one partial row per task, tag set and bucket is shuffled. "Last" means the largest ``recv_order``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import schema as S

ORDER_TAGS = ("market", "instrument", "broker")
PRICE_TAGS = ("market", "instrument")


def of_measurement(feed: DataFrame, name: str) -> DataFrame:
    """Rows of the message types that make up one measurement; unknown and reference types belong to none."""
    return feed.filter(F.col("msg_type").isin(*S.MEASUREMENTS[name]))


def measurement_of(msg_type: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, codes in S.MEASUREMENTS.items():
        label = F.when(msg_type.isin(*codes), name).otherwise(label)
    return label


def trade_value(price: Column, quantity: Column, exact_scale: int | None = None) -> Column:
    """Price times quantity. With ``exact_scale`` the price is taken as a decimal with that many digits after the point."""
    if exact_scale is None:
        return price * quantity
    return price.cast(f"decimal(18,{exact_scale})") * quantity.cast("decimal(10,0)")


def _count(kind: int) -> Column:
    return F.sum(F.when(F.col("msg_type") == kind, F.lit(1).cast("bigint")))


def _sum(kind: int, column: str) -> Column:
    return F.sum(F.when(F.col("msg_type") == kind, F.col(column).cast("bigint")))


def _last(kind: int, column: str) -> Column:
    of_kind = F.col("msg_type") == kind
    return F.max_by(F.when(of_kind, F.col(column)), F.when(of_kind, F.col("recv_order")))


def order_aggs() -> list[Column]:
    return [
        _count(S.ORDER_NEW).alias("newOrders"),
        _count(S.ORDER_NEW).alias("openOrders"),
        _sum(S.ORDER_NEW, "quantity").alias("totalOrderQty"),
        _count(S.ORDER_UPDATE).alias("modifiedOrders"),
        _count(S.ORDER_CANCEL).alias("cancelledOrders"),
        _sum(S.ORDER_CANCEL, "quantity").alias("totalCancelQty"),
    ]


def trade_aggs(exact_scale: int | None = None) -> list[Column]:
    value = trade_value(F.col("price"), F.col("quantity"), exact_scale)
    return [
        F.count("*").alias("numTrades"),
        F.sum(F.col("quantity").cast("bigint")).alias("totalVolume"),
        F.sum(value).cast("double").alias("totalValue"),
        F.max_by("price", "recv_order").alias("highPrice"),
        F.max_by("price", "recv_order").alias("lowPrice"),
        F.max("price").alias("maxPrice"),
        F.min("price").alias("minPrice"),
    ]


def quote_aggs() -> list[Column]:
    return [
        _count(S.QUOTE_BID).alias("bidUpdates"),
        _last(S.QUOTE_BID, "price").alias("bestBid"),
        _last(S.QUOTE_BID, "quantity").alias("bestBidQty"),
        _count(S.QUOTE_ASK).alias("askUpdates"),
        _last(S.QUOTE_ASK, "price").alias("bestAsk"),
        _last(S.QUOTE_ASK, "quantity").alias("bestAskQty"),
    ]


def order_metrics(feed: DataFrame, bucket: str = "bucket_ts") -> DataFrame:
    """New, open, modified and cancelled orders with their quantities, per market, instrument, broker and bucket."""
    return of_measurement(feed, "orders").groupBy(*ORDER_TAGS, F.col(bucket).alias("bucket_ts")).agg(*order_aggs())


def trade_metrics(feed: DataFrame, bucket: str = "bucket_ts", exact_scale: int | None = None) -> DataFrame:
    """Trades per market, instrument and bucket.

    ``highPrice`` and ``lowPrice`` are last values (each trade overwrites them); the extremes are ``maxPrice`` and
    ``minPrice``. ``exact_scale`` sums the value in decimals, so the sum does not depend on the order of the rows.
    """
    return of_measurement(feed, "trades").groupBy(*PRICE_TAGS, F.col(bucket).alias("bucket_ts")).agg(*trade_aggs(exact_scale))


def quote_metrics(feed: DataFrame, bucket: str = "bucket_ts") -> DataFrame:
    """Bid and ask updates and the last price and quantity of either side, per market, instrument and bucket."""
    return of_measurement(feed, "quotes").groupBy(*PRICE_TAGS, F.col(bucket).alias("bucket_ts")).agg(*quote_aggs())


def all_metrics(rolled: DataFrame, exact_scale: int | None = None) -> DataFrame:
    """All three measurements by one aggregate: ``measurement, market, instrument, broker, bucket_ts`` and the fields of all.

    ``rolled`` has ``measurement``; fields of another measurement than the row's mean nothing, and ``broker`` is null where it is no tag.
    """
    broker = F.when(F.col("measurement") == "orders", F.col("broker"))
    groups = rolled.groupBy("measurement", "market", "instrument", broker.alias("broker"), "bucket_ts")
    return groups.agg(*order_aggs(), *trade_aggs(exact_scale), *quote_aggs())


METRICS = {"orders": order_metrics, "trades": trade_metrics, "quotes": quote_metrics}
TAGS = {"orders": ORDER_TAGS, "trades": PRICE_TAGS, "quotes": PRICE_TAGS}
# The fields that are written, by measurement
FIELDS = {
    "orders": ("newOrders", "openOrders", "totalOrderQty", "modifiedOrders", "cancelledOrders", "totalCancelQty"),
    "trades": ("numTrades", "totalVolume", "totalValue", "highPrice", "lowPrice"),
    "quotes": ("bidUpdates", "bestBid", "bestBidQty", "askUpdates", "bestAsk", "bestAskQty"),
}
TAG_NAMES = {"market": "Market", "instrument": "Instrument", "broker": "Broker"}


def late_counts(rolled: DataFrame) -> DataFrame:
    """Late events per measurement, the metric updates they stand for, and the buckets written.

    ``rolled`` is a feed with ``measurement`` after :func:`tickloom.operators.arrival.roll_forward`.
    """
    weight = F.lit(0)
    for code, calls in S.UPDATES_PER_MESSAGE.items():
        weight = F.when(F.col("msg_type") == code, calls).otherwise(weight)
    return rolled.groupBy("measurement").agg(
        F.count_if("late").alias("late_events"),
        F.sum(F.when(F.col("late"), weight).otherwise(0)).cast("bigint").alias("late_updates"),
        F.count_distinct("bucket_ts").alias("flushes"),
    )

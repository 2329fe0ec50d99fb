"""Putting the SQL texts together."""

from __future__ import annotations

from tickloom.plans.feed import FEED_SQL, RESENT_SQL

HOUR = 3_600_000_000_000


def with_feed(body: str, **ctes: str) -> str:
    """``body`` over ``feed`` and further common tables, each usable by the ones after it."""
    parts = [f"feed as ({FEED_SQL})"] + [f"{name} as ({text})" for name, text in ctes.items()]
    return f"with {', '.join(parts)} {body}"


def rolled(source: str, keys: str = "measurement", period: int = HOUR) -> str:
    """``source`` with own and effective bucket, by a window over the whole feed."""
    part = f"partition by {keys}" if keys else ""
    return f"""
select *, ts_ns // {period} * {period} as own_bucket,
  max(ts_ns) over ({part} order by recv_order rows unbounded preceding) // {period} * {period} as bucket_ts
from {source}
"""


MEASURED = """
select *, case when msg_type in (1, 2, 3) then 'orders' when msg_type = 4 then 'trades' else 'quotes' end as measurement
from feed where msg_type between 1 and 6
"""

TRADE_AGG = """
count(*) as numTrades, cast(sum(quantity) as bigint) as totalVolume,
cast(sum(cast(price as decimal(18, 2)) * cast(quantity as decimal(10, 0))) as double) as totalValue,
arg_max(price, recv_order) as highPrice, arg_max(price, recv_order) as lowPrice,
max(price) as maxPrice, min(price) as minPrice
"""

ORDER_AGG = """
cast(sum(case when msg_type = 1 then 1 end) as bigint) as newOrders,
cast(sum(case when msg_type = 1 then 1 end) as bigint) as openOrders,
cast(sum(case when msg_type = 1 then quantity end) as bigint) as totalOrderQty,
cast(sum(case when msg_type = 2 then 1 end) as bigint) as modifiedOrders,
cast(sum(case when msg_type = 3 then 1 end) as bigint) as cancelledOrders,
cast(sum(case when msg_type = 3 then quantity end) as bigint) as totalCancelQty
"""

QUOTE_AGG = """
cast(sum(case when msg_type = 5 then 1 end) as bigint) as bidUpdates,
arg_max(case when msg_type = 5 then price end, case when msg_type = 5 then recv_order end) as bestBid,
arg_max(case when msg_type = 5 then quantity end, case when msg_type = 5 then recv_order end) as bestBidQty,
cast(sum(case when msg_type = 6 then 1 end) as bigint) as askUpdates,
arg_max(case when msg_type = 6 then price end, case when msg_type = 6 then recv_order end) as bestAsk,
arg_max(case when msg_type = 6 then quantity end, case when msg_type = 6 then recv_order end) as bestAskQty
"""

__all__ = ["with_feed", "rolled", "MEASURED", "TRADE_AGG", "ORDER_AGG", "QUOTE_AGG", "HOUR", "RESENT_SQL"]

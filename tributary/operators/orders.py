"""Store platforms: the orders fact.

``order_id`` is text in the fact because one platform's order numbers are text and
identity resolution compares text.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame

from tributary.registry import register_engine
from tributary.sources.sinks import conform

STORE_SOURCES = ("shopify", "woocommerce", "bigcommerce")

# Star column -> unpacked column.
_NAMES = {
    "shopify": {"order_date": "order_created_at", "customer_email": "email"},
    "woocommerce": {"order_date": "order_created_at", "financial_status": "order_status"},
    "bigcommerce": {
        "order_date": "order_created_at",
        "financial_status": "order_status",
        "customer_email": "billing_email",
    },
}


def orders(rows: DataFrame, source: str) -> DataFrame:
    return conform(rows, "fct_orders", **_NAMES[source])


for _source in STORE_SOURCES:
    register_engine(_source, "orders", partial(orders, source=_source))

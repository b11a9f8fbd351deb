"""Orders stored by customer, so that what goes by customer needs no shuffle.

Orders are dealt to buckets by customer once, when they are stored.  A bucket is read by one task:
customers with a large part of all orders, who would fill one, are stored apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.joins import HOT_PARTS
from tillroll.functions.numeric import exprs
from tillroll.operators.cohorts import month_index
from tillroll.sources.staging import shared_folder, staged


class CustomerOrders(NamedTuple):
    """``bucketed`` rows of most customers; ``apart`` those of hot customers and of none."""

    bucketed: DataFrame
    apart: DataFrame

    def per_customer(self, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A result that goes by customer: every customer is on one side alone."""
        return operator(self.bucketed).unionByName(operator(self.apart))


def store_by_customer(df: DataFrame, buckets: int | None = None, hot_parts: int = HOT_PARTS) -> CustomerOrders:
    """Write ``df`` in buckets by customer, hot customers apart, and return both to read.

    A customer with more than one part in ``hot_parts`` of all orders is hot, so fewer than
    ``hot_parts`` are.  ``buckets`` is the number of shuffle partitions unless given: choose it so that
    a bucket fits a task.  Orders without a customer are stored apart with the hot.  The tables lie in
    the shared folder.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = staged(df, "orders")
    sizes = source.filter("customer_id IS NOT NULL").groupBy("customer_id").agg(*exprs(_n="count(1)"))
    total = source.agg(*exprs(n="count(1)")).scalar()
    hot = sizes.withColumn("_total", total).filter(f"_n * {hot_parts} > _total").select("customer_id")
    hot = F.broadcast(staged(hot, "hot"))  # fewer than ``hot_parts`` ids
    name = f"orders_by_customer_{uuid.uuid4().hex}"
    cold = source.filter("customer_id IS NOT NULL").join(hot, "customer_id", "left_anti")
    # Dealt like the buckets, so that each is one file.
    dealt = cold.repartition(buckets, "customer_id").sortWithinPartitions("customer_id")
    path = f"{shared_folder(spark)}/{name}"
    writer = dealt.select(*df.columns).write.option("path", path).option("compression", "zstd")
    writer.bucketBy(buckets, "customer_id").sortBy("customer_id").format("parquet").saveAsTable(name)
    apart = source.join(hot, "customer_id", "left_semi").unionByName(source.filter("customer_id IS NULL"))
    return CustomerOrders(spark.table(name), staged(apart.select(*df.columns), "apart"))


def cohort_orders(orders: CustomerOrders) -> DataFrame:
    """Every order with its cohort month, its own month and the months between.

    Within a bucket by a window over each customer, who is none of the hot; the hot by a join with
    their first dates, fewer rows than ``hot_parts``.  No order is shuffled.
    """
    columns = orders.bucketed.columns
    first = "min(order_date) OVER (PARTITION BY customer_id) AS _first"
    cold = orders.bucketed.selectExpr("*", first)
    firsts = orders.apart.filter("customer_id IS NOT NULL").groupBy("customer_id").agg(*exprs(_first="min(order_date)"))
    hot = orders.apart.join(F.broadcast(firsts), "customer_id", "left").select(*columns, "_first")
    return cold.unionByName(hot).selectExpr(
        *columns,
        "date_format(_first, 'yyyy-MM') AS cohort_month",
        "date_format(order_date, 'yyyy-MM') AS order_period",
        f"{month_index('order_date')} - {month_index('_first')} AS months_since_cohort",
    )

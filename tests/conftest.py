import os
import sys
from datetime import date

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillroll.plans.session import local_session  # noqa: E402
from tillroll.schema import CLEAN_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", "4", 4)
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


BASE = {
    "order_id": "ORD-1",
    "order_date": date(2022, 1, 5),
    "customer_id": "CUST-1",
    "customer_segment": "Regular",
    "region": "West",
    "product_category": "Books",
    "product_name": "Cookbook",
    "quantity": 1,
    "unit_price": 10.0,
    "discount_pct": 0.0,
    "revenue": 10.0,
    "cost": 6.0,
    "profit": 4.0,
    "payment_method": "Paypal",
    "shipping_type": "Standard",
    "order_status": "Delivered",
    "customer_rating": 4.0,
}


@pytest.fixture
def orders(spark):
    """Clean orders from partial rows; the rest takes a default."""

    def make(*rows):
        full = []
        for i, row in enumerate(rows):
            merged = {**BASE, "order_id": f"ORD-{i}", **row}
            day = merged["order_date"]
            merged |= {
                "order_year": day.year,
                "order_month": day.month,
                "order_quarter": (day.month + 2) // 3,
                "order_day_of_week": day.strftime("%A"),
                "order_week": day.isocalendar()[1],
            }
            full.append(tuple(merged[f.name] for f in CLEAN_SCHEMA.fields))
        return spark.createDataFrame(full, CLEAN_SCHEMA)

    return make


def rows_of(df):
    return [r.asDict() for r in df.collect()]

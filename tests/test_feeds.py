"""The derived feeds."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.plans.feeds import level_rows

from .conftest import SF


def test_arrivals_are_numbered_by_stretches(spark):
    """Numbers as by a window over each feed, without one that puts a whole feed into one task."""
    for symbol in ("event_type", "user_id"):
        rows = level_rows(spark, SF, symbol)
        n = F.row_number().over(Window.partitionBy("symbol").orderBy("event_id"))
        assert rows.where("arrival is null").count() == 0 and rows.withColumn("n", n).where("n != arrival").count() == 0
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "row_number" not in plan and "_stretch" in plan

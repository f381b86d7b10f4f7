"""Filing delays: from monthly filings to lateness and frequency per vendor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelight.functions.text import any_date, due_date, in_window, period_start

RETURN_TYPES = ("GSTR3B", "GSTR1")


def delays(filings: DataFrame, as_of: Column) -> DataFrame:
    """vendor_id, return_type, period, delay_days of dated filings in the last twelve times 31 days (DAT-02..04)."""
    rows = filings.where(F.col("return_type").isin(*RETURN_TYPES))
    rows = rows.withColumn("period", period_start(F.col("tax_period"), F.col("financial_year"))).withColumn("filed", any_date(F.col("date_of_filing")))
    rows = rows.where(F.col("filed").isNotNull() & in_window(F.col("period"), as_of))
    late = F.greatest(F.lit(0), F.date_diff("filed", due_date(F.col("period"), F.col("return_type"))))
    return rows.select("vendor_id", "return_type", "period", late.alias("delay_days"))


def filing_summary(delay_rows: DataFrame, by_type: bool = False) -> DataFrame:
    """Periods, late ones and the longest delay per vendor (and return type) (AGG-03, AGG-05)."""
    keys = ["vendor_id", "return_type"] if by_type else ["vendor_id"]
    return delay_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("periods"), F.count_if(F.col("delay_days") > 0).alias("late"), F.max("delay_days").alias("max_delay"))


def filing_bucket(late: Column) -> Column:
    """Bucket of a late count (AGG-04)."""
    return F.when(late == 0, "timely").when(late <= 3, "minor_delays").when(late <= 5, "five_delays").when(late.isNotNull(), "significant_delays")


def latest_frequency(rows: DataFrame) -> DataFrame:
    """monthly or quarterly by the latest quarter, the last of ties (WIN-01); null for other words."""
    last = rows.groupBy("vendor_id").agg(F.max_by("frequency", F.struct(F.coalesce("financial_year", F.lit("")), F.coalesce("quarter", F.lit("")), "pos")).alias("raw"))
    low = F.lower(F.trim("raw"))
    value = F.when(low.contains("month"), "monthly").when(low.contains("quarter") | low.contains("qrmp"), "quarterly")
    return last.select("vendor_id", value.alias("frequency"))

"""Queries over streams."""

from pyspark.sql import functions as F

from quillspark.streaming.logs import event_stream, run_to_table, windowed_counts


def queries():
    def daily(spark, sf):
        found = run_to_table(windowed_counts(event_stream(spark, sf)), "daily-counts")
        return found.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")

    return {"str_09_daily_counts": daily}


def oracle_sql():
    return {"str_09_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"}

"""The registry of the library's queries over the driver's tables, and the SQL that checks them.

Names begin with the operator's number in the survey.  A query without SQL is sequential or hashes as
Spark does; the tests hold it against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import queries_events, queries_files, queries_images, queries_joins, queries_streams


def event_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, users, span and exact value statistics of events by type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return (
        events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
        .groupBy("event_type")
        .agg(
            F.count("*").alias("n"),
            F.countDistinct("user_id").alias("n_users"),
            F.round(F.avg("value"), 6).alias("mean_value"),
            F.round(F.median("value"), 6).alias("median_value"),
            F.round(F.percentile("value", 0.95), 6).alias("p95_value"),
            F.max("k").alias("max_k"),
        )
        .orderBy("event_type")
    )


QUERIES = {
    "event_profile": event_profile,
    **queries_images.QUERIES,
    **queries_events.QUERIES,
    **queries_joins.QUERIES,
    **queries_files.QUERIES,
    **queries_streams.QUERIES,
}

ORACLE_SQL = {
    "event_profile": """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(avg(value), 6) AS mean_value,
       round(quantile_cont(value, 0.5), 6) AS median_value, round(quantile_cont(value, 0.95), 6) AS p95_value,
       max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS max_k
FROM events GROUP BY event_type
""",
    **queries_images.ORACLE_SQL,
    **queries_events.ORACLE_SQL,
    **queries_joins.ORACLE_SQL,
    **queries_files.ORACLE_SQL,
    **queries_streams.ORACLE_SQL,
}

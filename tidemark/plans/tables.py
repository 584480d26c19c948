"""The driver's tables in the shapes of the reference's records.

The mappings are plain SQL projections that Spark and DuckDB read alike, so that a query and the SQL
that checks it start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: documents as images; boxes are added below
IMAGES = """
SELECT lang AS dataset, CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split,
       concat('img/', CAST(doc_id AS STRING), '.jpg') AS path, concat(source, '_', CAST(doc_id AS STRING), '.jpg') AS filename,
       CAST(320 + 320 * (n_chars % 3) AS INT) AS width, CAST(240 + 240 * (n_chars % 2) AS INT) AS height,
       n_chars % 13 = 0 AS is_corrupt, n_chars % 4 = 0 AS is_negative, n_chars AS n, doc_id, text
FROM documents
"""
#: order lines as corner boxes of 640 x 480 images, one image an order
BOXES = """
SELECT l_orderkey AS image, l_linenumber AS ord, 10 * l_quantity AS x1, 2000 * l_discount AS y1,
       10 * l_quantity + 8 + 20 * l_linenumber AS x2, 2000 * l_discount + 6 + 1000 * l_tax AS y2,
       CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS cls, l_discount * 10 AS conf
FROM lineitem
"""
#: the same boxes a little moved, as predictions
MOVED = """
SELECT image, ord, x1 + 1 + ord AS x1, y1 + 2 AS y1, x2 + 1 + ord AS x2, y2 + 2 AS y2, cls, conf FROM boxes
"""
#: order lines as numbered frames with gaps and size changes
ENTRIES = """
SELECT concat('clip', CAST(l_orderkey % 500 AS STRING), '_') AS prefix, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS idx,
       concat('clip', CAST(l_orderkey % 500 AS STRING), '_', CAST(l_orderkey * 8 + l_linenumber AS STRING)) AS name,
       CASE WHEN min(l_shipdate) < TIMESTAMP '1995-06-17 00:00:00' THEN 640 ELSE 320 END AS width, 480 AS height
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""
#: events as a stream of flags, seconds from the first event of all
STREAM = """
SELECT user_id, event_id, event_type, value, CAST(event_id AS DOUBLE) / 4 AS ts_sec,
       event_type IN ('click', 'view', 'error') AS flag
FROM events
"""
#: orders as clips of an evaluation
CLIPS = """
SELECT o_orderpriority AS variant, o_orderstatus <> 'P' AND o_custkey % 2 = 0 AS label, o_totalprice > 150000 AS detected,
       CASE WHEN o_custkey % 2 = 0 AND o_totalprice > 150000 THEN CAST(o_orderkey % 50 AS DOUBLE) / 10 END AS ttd_sec,
       o_orderkey % 7 AS false_frames, o_orderkey % 90 AS negative_frames, o_orderkey % 3 AS incidents,
       CAST(o_orderkey % 90 AS DOUBLE) / 30 AS negative_sec
FROM orders
"""
#: order lines as label lines, good and bad
LINES = """
SELECT concat('l/', CAST(l_orderkey AS STRING)) AS path, l_orderkey, l_linenumber,
       concat(CASE WHEN l_linenumber = 7 THEN '7' WHEN l_linenumber = 6 THEN '0.0' ELSE CAST(l_linenumber % 2 AS STRING) END, ' ',
              CASE WHEN l_quantity = 1 THEN 'nan' ELSE CAST(CAST(l_quantity AS INT) * 0.02 AS STRING) END, ' 0.5 ',
              CASE WHEN l_quantity = 2 THEN '0' WHEN l_quantity = 3 THEN '1.5' ELSE '0.25' END, ' 0.125',
              CASE WHEN l_quantity = 4 THEN ' 9' ELSE '' END) AS line
FROM lineitem
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(spark: SparkSession, sf_dir: str, sql: str, **views: DataFrame) -> DataFrame:
    """A mapping's rows; {name} placeholders of spark.sql hold its tables, or the views given."""
    for name in ("documents", "lineitem", "events", "orders"):
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
        if f"{{{name}}}" in sql:
            views.setdefault(name, table(spark, sf_dir, name))
    for name in ("boxes",):
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **views)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMAGES with n % 4 boxes each."""
    n = F.col("n")
    numbers = F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), 1, (n % 4).cast("int"))
    made = F.transform(
        numbers,
        lambda i: F.struct(
            ((n + i) % 2).cast("int").alias("class_id"), F.lit(0.5).alias("x_center"), F.lit(0.5).alias("y_center"),
            ((1 + (n * i) % 9) / 20).alias("width"), ((1 + (n + i) % 7) / 20).alias("height"),
        ),
    )
    return mapped(spark, sf_dir, IMAGES).withColumn("boxes", made)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir, BOXES)


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir, MOVED, boxes=boxes(spark, sf_dir))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as frames of 20 streams at 30 per second: track rows in slow growth, some frames empty.

    Every shown line is a track row: its number is the track's, plus seven for each line of that number before it.
    Lines that aren't shown make one row of their frame, without a track.
    """
    again = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("_again", F.row_number().over(again) - 1)
    at = F.col("l_orderkey")
    stream, frame = (at % 20), F.floor(at / 20)
    side = 14 + (frame % 300) / 20 + F.col("l_linenumber")
    shown = (F.col("l_quantity") > 2) & ((frame % 300) > 20)
    return rows.select(
        F.concat(F.lit("cam"), stream.cast("string")).alias("stream_id"), frame.alias("frame_index"),
        (frame / 30).alias("ts_sec"), F.lit(640).alias("image_w"), F.lit(640).alias("image_h"),
        (100 + 10 * F.col("l_linenumber")).cast("double").alias("x1"), F.lit(100.0).alias("y1"),
        (100 + 10 * F.col("l_linenumber") + side).alias("x2"), (100 + side).alias("y2"),
        F.when(shown, F.col("l_linenumber") + 7 * F.col("_again")).cast("int").alias("track_id"),
        (0.3 + F.col("l_discount") * 4).alias("conf"), (F.col("l_linenumber") % 2).cast("int").alias("cls"),
    ).dropDuplicates(["stream_id", "frame_index", "track_id"])


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tracks with each order line as a detector's box too, and each fifth frame's first line as a reviewed box."""
    lines = table(spark, sf_dir, "lineitem")
    frame, side = F.floor(F.col("l_orderkey") / 20), 10 + F.col("l_quantity")
    left = (100 + 10 * F.col("l_linenumber")).cast("double")
    boxes = lines.select(
        F.concat(F.lit("cam"), (F.col("l_orderkey") % 20).cast("string")).alias("stream_id"), frame.alias("frame_index"),
        (frame / 30).alias("ts_sec"), F.lit(640).alias("image_w"), F.lit(640).alias("image_h"), left.alias("x1"), F.lit(100.0).alias("y1"),
        (left + side).cast("double").alias("x2"), (100 + side).cast("double").alias("y2"), F.lit(None).cast("int").alias("track_id"),
        (F.col("l_discount") * 3 + 0.012).alias("conf"), (F.col("l_linenumber") % 2).cast("int").alias("cls"), F.lit("box").alias("kind"),
        F.col("l_linenumber").alias("_line"),
    )
    truth = boxes.where("frame_index % 5 = 0 AND _line = 1").withColumn("kind", F.lit("truth"))
    own = tracks(spark, sf_dir).withColumn("kind", F.when(F.col("track_id").isNotNull(), "track"))
    return own.unionByName(boxes.drop("_line")).unionByName(truth.drop("_line"))


IMAGE_BOXES = f"""
img AS ({IMAGES.replace("AS STRING", "AS VARCHAR")}),
box AS (SELECT dataset, split, path, width, height, is_corrupt, n, i, (n + i) % 2 AS class_id,
               (1 + (n * i) % 9) / 20 AS w, (1 + (n + i) % 7) / 20 AS h FROM img, range(1, 4) t(i) WHERE i <= n % 4)
"""


def duck(sql: str) -> str:
    return sql.replace("AS STRING", "AS VARCHAR")

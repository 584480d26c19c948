"""Queries that join, compare, split, verify and merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import boxes as bx
from tidemark.functions import text as tx
from tidemark.functions.hashing import digest, sign_hash
from tidemark.operators import dedup, joins, merge, metrics, split, verify
from tidemark.plans import tables as t
from tidemark.plans.queries_images import line_errors
from tidemark.sources import readers


def j1_first_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with the first order of its most urgent priority."""
    orders = t.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderkey")
    return joins.with_first_label(t.table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "o_orderpriority")


def j2_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (t.table(spark, sf_dir, n) for n in ("documents", "labels"))
    return joins.with_defaults(docs.select("doc_id", "lang"), labels, "doc_id", {"quality": -1, "toxic": -1})


def j3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3-J5, U5."""
    docs, labels = (t.table(spark, sf_dir, n) for n in ("documents", "labels"))
    return joins.unmatched(docs.select("doc_id", "source"), labels, "doc_id")


def j6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = t.table(spark, sf_dir, "labels").where("toxic = 1")
    return joins.groups_of(toxic, t.table(spark, sf_dir, "documents"), "doc_id", "source")


def j7_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.table(spark, sf_dir, "orders")
    return dedup.adjacent_pairs(
        orders.select(
            (F.col("o_orderkey") % 50).alias("prefix"), F.floor(F.col("o_orderkey") / 50).alias("number"),
            F.col("o_orderkey").alias("name"), F.col("o_orderstatus").alias("split"),
        )
    )


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "embeddings").select("vec_id", sign_hash(F.col("embedding")).alias("h"))


def j8_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, X24, X25."""
    rows = _vectors(spark, sf_dir)
    return dedup.near_pairs(rows, rows, "vec_id", "h", 18, one_sided=True)


def r1_banded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors against copies with two to five signs turned."""
    rows = _vectors(spark, sf_dir)
    turned = rows.withColumn("h", F.col("h").bitwiseXOR(F.lit((1 << 5) | (1 << 40)) + F.when(F.col("vec_id") % 2 == 0, (1 << 11) | (1 << 23) | (1 << 61)).otherwise(0)))
    return dedup.near_pairs(rows, turned, "vec_id", "h", 4)


def j8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within the limits of 4 and 8 bits."""
    rows = _vectors(spark, sf_dir)
    turned = rows.withColumn("h", F.col("h").bitwiseXOR(F.lit((1 << 5) | (1 << 40)) + F.when(F.col("vec_id") % 2 == 0, (1 << 11) | (1 << 23) | (1 << 61)).otherwise(0)))
    return dedup.near_pairs(rows, turned, "vec_id", "h", 8).withColumn("near", F.col("distance") <= 4)


def j9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, U3, X27."""
    rows = t.table(spark, sf_dir, "documents").select(digest(F.col("text")).alias("sha256"), "source")
    return dedup.exact_duplicates(rows, "sha256", "source").withColumn("splits", F.array_join("splits", ","))


def j12_authoritative(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("at"))
    orders = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("at"))
    return joins.authoritative(lines, orders, "l_orderkey", "at")


def j14_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") / 30).alias("ts_sec"))
    other = events.withColumn("ts_sec", F.col("ts_sec") + F.when(F.col("event_id") % 9 == 0, 0.001).otherwise(0.00001))
    return joins.positional(events, other, "event_id", "ts_sec").select("event_id", "in_time")


def j15_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.boxes(spark, sf_dir).select(
        "image", "ord", "cls", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"),
        F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("side"),
    )
    return joins.close_of_other_class(rows, ["image"]).select("image", "ord", "together")


def j16_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16, E6."""
    rows = t.table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.avg("l_tax").alias("tax"), F.avg("l_discount").alias("discount"))
    found = joins.paired(rows, "l_returnflag", "A", "R", ["l_linenumber"], ["tax", "discount"])
    return found.select("l_linenumber", F.round("tax", 6).alias("tax"), F.round("discount", 6).alias("discount"))


def e5_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bounds(t.table(spark, sf_dir, "lineitem"), "l_quantity", "l_orderkey")


def u1_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of train that test holds too."""
    rows = t.images(spark, sf_dir).select("split", F.sha2("text", 256).alias("sha256"))
    return dedup.overlap(rows.where("split = 'train'"), rows.where("split = 'test'"), "sha256")


def u6_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = t.table(spark, sf_dir, "customer"), t.table(spark, sf_dir, "orders").withColumn("c_custkey", F.col("o_custkey") + 5)
    return dedup.key_difference(a, b, "c_custkey")


def u8_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.is_subset(t.table(spark, sf_dir, "labels"), t.table(spark, sf_dir, "documents"), "doc_id")


def w8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.repeats(t.table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id")


def m2_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2, M3, M8, U7."""
    orders = t.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return dedup.keep_last(orders, ["o_custkey"], "o_orderkey")


def m1_worksheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers but each fifth as the worksheet, all but each third as suggestions."""
    rows = t.table(spark, sf_dir, "customer")
    old = rows.where("c_custkey % 5 <> 0").select(
        F.col("c_name").alias("video_path"), F.lit("10").alias("fps"), F.lit("human").alias("notes"), F.lit("a").alias("source_sha256"),
        F.lit("ok").alias("review_status"),
    )
    new = rows.where("c_custkey % 3 <> 0").select(
        F.col("c_name").alias("video_path"), F.lit("30").alias("fps"), F.lit("machine").alias("notes"),
        F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b").alias("auto_source_sha256"),
    )
    return merge.merge_worksheet(old, new)


def m4_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.table(spark, sf_dir, "orders")
    store = orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("clip_id"), (F.col("o_orderkey") % 4).cast("int").alias("revision"))
    saves = orders.select(F.col("o_orderkey").alias("clip_id"), (F.col("o_custkey") % 4).cast("int").alias("base_revision"))
    return merge.save_reviews(store, saves)


def m6_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = t.images(spark, sf_dir).select(F.col("dataset").alias("clip"), F.col("doc_id").alias("frame_index"), "boxes")
    there = frames.where("frame_index % 5 = 0").select("clip", F.concat("frame_index", F.lit(":0:false_positive")).alias("id"))
    return merge.batch_flags(frames, there).select("clip", "id")


def m7_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return merge.changed_artifacts(rows, rows.withColumn("p_size", F.col("p_size") + (F.col("p_partkey") % 50 == 0).cast("int")))


def m9_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = t.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return merge.pending(parts, parts.where("p_size < 20"), ["p_brand", "p_size"])


def g1_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: conversations stay whole."""
    return split.ranked_split(t.table(spark, sf_dir, "conversations"), "conv_id", 0.8).select("conv_id", "turn", "split")


def g2_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80 of 100 documents of every language train."""
    rows = split.ranked_split(t.table(spark, sf_dir, "documents"), "doc_id", 0.8, strata="lang")
    return rows.groupBy("lang", "split").agg(F.count("*").alias("n"))


def g6_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.isolate(t.images(spark, sf_dir)).groupBy("dataset", "split").agg(F.count("*").alias("n"))


def ac_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AC1-AC8, AC10 on documents as images and conversations' turns as frame numbers."""
    images = t.images(spark, sf_dir).withColumn("sha256", F.sha2("text", 256)).withColumn("video_id", F.lit(None).cast("string"))
    manifest = t.table(spark, sf_dir, "conversations").select(
        F.concat_ws("_", "conv_id", "turn").alias("filename"), F.concat_ws("/", F.lit("img"), "conv_id", "turn").alias("path"),
        F.lit("fire").alias("category"), F.col("conv_id").cast("string").alias("video_id"), F.col("turn").cast("int").alias("frame_index"),
        F.lit(5).alias("sequence_length"), F.lit(640).alias("width"), F.when(F.col("role") == "system", 360).otherwise(480).alias("height"),
    )
    lines = t.mapped(spark, sf_dir, t.LINES).select("path", bx.validated_line(F.col("line"), bx.V1).alias("checked"))
    found = verify.verified(images, manifest, manifest.select("path").where("path NOT LIKE '%/3'"), lines)
    return found.select("id", "status")


def qa_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("frame_index"),
        F.array(F.lit(1), F.lit(2), F.lit(3)).alias("raw"),
        F.when(F.col("value") > 50, F.array(F.lit(9))).otherwise(F.array(F.lit(1), F.lit(2))).alias("filtered"),
        F.array(F.lit(1)).alias("confirmed"), F.when(F.col("event_type") == "error", F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("ids"),
    )
    return verify.replay_invariants(rows)


def qc_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents")
    path = F.concat(F.when(F.col("doc_id") % 11 == 0, "/").when(F.col("doc_id") % 13 == 0, "a/../").otherwise("a/"), F.col("doc_id").cast("string"))
    manifest = docs.select(path.alias("path"), F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.sha2("text", 256)).alias("sha256"))
    files = docs.where("doc_id % 5 <> 0").select(path.alias("path"), F.sha2(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")), 256).alias("actual"))
    return joins.evidence(manifest, files).groupBy("problem").agg(F.count("*").alias("n"))


def qd_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.images(spark, sf_dir).select("split", F.col("doc_id").alias("stem"))
    return verify.detection_verification(rows.where("stem % 9 <> 0"), rows.where("stem % 4 <> 0"))


def s21_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page paths, and the JSON value in a script element that each page is given."""
    pages = t.table(spark, sf_dir, "pages")
    data = F.concat(F.lit('{"id":'), F.col("page_id").cast("string"), F.lit(',"frames":[[1,2],[3]],"name":"p'), (F.col("page_id") % 7).cast("string"), F.lit('"}'))
    script = F.when(F.col("page_id") % 9 != 0, F.concat(F.lit('<script id="data" type="application/json">'), data, F.lit("</script>"))).otherwise("")
    given = pages.withColumn("html", F.concat("html", script))
    found = readers.embedded(given, "data", "id bigint, frames array<array<int>>, name string")
    return found.select(
        "page_id", tx.posix(F.col("url")).alias("url"), F.coalesce("data.id", F.lit(-1)).alias("id"), F.coalesce("data.name", F.lit("")).alias("name"),
        F.coalesce(F.size(F.flatten("data.frames")), F.lit(0)).alias("boxes"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        j1_first_label, j2_defaults, j3_unmatched, j6_groups, j7_adjacent, j8_near_pairs, j8_limits, r1_banded_pairs, j9_exact,
        j12_authoritative, j14_positional, j15_together, j16_paired, e5_bounds, u1_overlap, u6_difference, u8_subset, w8_repeats,
        m1_worksheet, m2_latest, m4_save, m6_flags, m7_changed, m9_pending, g1_split, g2_stratified, g6_isolated, ac_criteria,
        qa_invariants, qc_evidence, qd_detection, s21_pages,
    )
}

_IMG = f"WITH {t.IMAGE_BOXES}"
_SIGNS = "WITH e AS (SELECT vec_id, list_transform(embedding[1:64], lambda v: v > 0) AS b FROM embeddings)"
_TURNED = f"""{_SIGNS}, t AS (SELECT vec_id, list_transform(range(1, 65), lambda i: b[i] <> (i IN (59, 24) OR (vec_id % 2 = 0 AND i IN (53, 41, 3)))) AS b FROM e),
p AS (SELECT x.vec_id AS a, y.vec_id AS b, CAST(len(list_filter(list_zip(x.b, y.b), lambda z: z[1] <> z[2])) AS INT) AS distance FROM e x, t y)"""

ORACLE_SQL = {
    "ac_criteria": f"""WITH {t.IMAGE_BOXES.strip()}, im AS (SELECT split, path, sha256(text) AS sha FROM img),
        m AS (SELECT concat_ws('/', 'img', conv_id, turn) AS path, concat_ws('_', conv_id, turn) AS filename, CAST(conv_id AS VARCHAR) AS v, turn AS i,
          CASE WHEN role = 'system' THEN 360 ELSE 480 END AS h FROM conversations),
        g AS (SELECT v, count(*) AS n, min(i) AS a, max(i) AS b, count(DISTINCT i) AS d, count(DISTINCT h) AS hs FROM m GROUP BY v),
        l AS ({t.duck(t.LINES)}), s AS (SELECT string_split(line, ' ') AS p FROM l),
        w AS (SELECT len(p) AS n, p[1] AS k, CASE WHEN p[2] <> 'nan' THEN CAST(p[2] AS DOUBLE) END AS x, CAST(p[3] AS DOUBLE) AS y, CAST(p[4] AS DOUBLE) AS w, CAST(p[5] AS DOUBLE) AS h FROM s),
        e AS (SELECT {line_errors("1e-4", True, False)} AS error FROM w),
        c(id, bad, known) AS (
          SELECT 'AC1', (SELECT count(*) FROM m WHERE path NOT LIKE '%/3' AND path NOT IN (SELECT path FROM m)), 1
          UNION ALL SELECT 'AC2', (SELECT count(*) FROM g WHERE a <> 0 OR b <> n - 1 OR d <> n), 1
          UNION ALL SELECT 'AC3', (SELECT count(*) FROM g WHERE hs > 1), 1
          UNION ALL SELECT 'AC4', (SELECT count(*) FROM g WHERE a <> 0 OR b <> n - 1 OR d <> n OR n <> 5), 1
          UNION ALL SELECT 'AC5', (SELECT count(*) FROM (SELECT filename FROM m GROUP BY filename HAVING count(*) > 1)), 1
          UNION ALL SELECT 'AC6', (SELECT count(*) FROM (SELECT path FROM im GROUP BY path HAVING count(DISTINCT split) > 1)), 1
          UNION ALL SELECT 'AC7', (SELECT count(*) FROM (SELECT path FROM im WHERE split = 'test' INTERSECT SELECT path FROM im WHERE split <> 'test')), (SELECT count(path) FROM im)
          UNION ALL SELECT 'AC8', (SELECT count(*) FROM e WHERE error IS NOT NULL), 1
          UNION ALL SELECT 'AC10', (SELECT count(*) FROM (SELECT sha FROM im WHERE split = 'test' INTERSECT SELECT sha FROM im WHERE split <> 'test')), (SELECT count(sha) FROM im))
        SELECT id, CASE WHEN known = 0 THEN 'SKIPPED' WHEN bad > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM c""",
    "j1_first_label": """SELECT c_custkey, arg_min(o_orderpriority, (o_orderpriority, o_orderkey)) AS o_orderpriority,
        arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
    "j2_defaults": "SELECT doc_id, lang, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "j3_unmatched": "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)",
    "j6_groups": "SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1",
    "j7_adjacent": """SELECT a.o_orderkey AS image_a, a.o_orderstatus AS split_a, b.o_orderkey AS image_b, b.o_orderstatus AS split_b
        FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 50 WHERE a.o_orderstatus <> b.o_orderstatus""",
    "j8_near_pairs": f"""{_SIGNS}, p AS (SELECT x.vec_id AS a, y.vec_id AS b, CAST(len(list_filter(list_zip(x.b, y.b), lambda z: z[1] <> z[2])) AS INT) AS distance
        FROM e x JOIN e y ON x.vec_id < y.vec_id) SELECT a, b, distance FROM p WHERE distance <= 18""",
    "r1_banded_pairs": f"{_TURNED} SELECT a, b, distance FROM p WHERE distance <= 4",
    "j8_limits": f"{_TURNED} SELECT a, b, distance, distance <= 4 AS near FROM p WHERE distance <= 8",
    "j9_exact": """SELECT sha256(text) AS sha256, count(*) AS copies, string_agg(DISTINCT source, ',' ORDER BY source) AS splits
        FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1""",
    "j12_authoritative": "SELECT l_orderkey, l_linenumber, o_orderdate AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "j14_positional": "SELECT event_id, event_id % 9 <> 0 AS in_time FROM events",
    "j15_together": f"""WITH b AS ({t.BOXES}), c AS (SELECT image, ord, cls, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, greatest(x2 - x1, y2 - y1) AS s FROM b)
        SELECT a.image, a.ord, EXISTS (SELECT 1 FROM c o WHERE o.image = a.image AND o.cls <> a.cls
          AND sqrt(pow(a.x - o.x, 2) + pow(a.y - o.y, 2)) <= 2.5 * greatest(a.s, o.s)) AS together FROM c a""",
    "j16_paired": """WITH r AS (SELECT l_linenumber, l_returnflag, avg(l_tax) AS t, avg(l_discount) AS d FROM lineitem GROUP BY ALL)
        SELECT a.l_linenumber, round(b.t - a.t, 6) AS tax, round(b.d - a.d, 6) AS discount FROM r a JOIN r b USING (l_linenumber)
        WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R'""",
    "e5_bounds": "SELECT l_orderkey, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY l_orderkey",
    "u1_overlap": f"""{_IMG} SELECT sha256(text) AS sha256 FROM img WHERE split = 'train' INTERSECT SELECT sha256(text) FROM img WHERE split = 'test'""",
    "u6_difference": """(SELECT c_custkey, 'left' AS side FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey + 5 FROM orders))
        UNION ALL (SELECT c_custkey, 'right' FROM (SELECT o_custkey + 5 AS c_custkey FROM orders EXCEPT SELECT c_custkey FROM customer))""",
    "u8_subset": "SELECT count(*) AS missing, count(*) = 0 AS subset FROM labels ANTI JOIN documents USING (doc_id)",
    "w8_repeats": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n > 1",
    "m1_worksheet": """WITH o AS (SELECT * FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS h FROM customer WHERE c_custkey % 3 <> 0)
        SELECT coalesce(o.c_name, n.c_name) AS video_path, CASE WHEN n.c_name IS NULL THEN '10' ELSE '30' END AS fps, CASE WHEN o.c_name IS NULL THEN 'machine' ELSE 'human' END AS notes,
          CASE WHEN o.c_name IS NULL THEN n.h ELSE 'a' END AS source_sha256,
          CASE WHEN o.c_name IS NOT NULL AND n.h = 'b' THEN 'source_changed_review_needed' WHEN o.c_name IS NOT NULL THEN 'ok' END AS review_status,
          n.h AS auto_source_sha256, '' AS t_ignition_start_sec, '' AS t_aftermath_start_sec, '' AS should_alert_human FROM o FULL JOIN n ON o.c_name = n.c_name""",
    "m2_latest": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey",
    "m4_save": """WITH x AS (SELECT o_orderkey AS clip_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 4 END AS INT) AS r, o_custkey % 4 AS b FROM orders)
        SELECT clip_id, r + CAST(b = r AS INT) AS revision, CASE WHEN b = r THEN 'saved' ELSE 'conflict' END AS outcome FROM x""",
    "m6_flags": f"""{_IMG} SELECT dataset AS clip, concat(n.doc_id, ':', i - 1, ':false_positive') AS id FROM box JOIN img n USING (path, dataset) WHERE NOT (n.doc_id % 5 = 0 AND i = 1)""",
    "m7_changed": """SELECT p_partkey, p_size, 'before' AS side FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT p_partkey, p_size + 1, 'after' FROM part WHERE p_partkey % 50 = 0""",
    "m9_pending": "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size >= 20",
    "g2_stratified": """WITH c AS (SELECT lang, count(DISTINCT doc_id) AS n FROM documents GROUP BY lang), k AS (SELECT lang, n, greatest(1, least(n - 1, CAST(floor(n * 0.8) AS BIGINT))) AS k FROM c)
        SELECT lang, 'train' AS split, k AS n FROM k UNION ALL SELECT lang, 'val', n - k FROM k""",
    "g6_isolated": f"""{_IMG} SELECT dataset, CASE WHEN is_corrupt THEN 'quarantine' ELSE 'test' END AS split, count(*) AS n FROM img GROUP BY ALL""",
    "qa_invariants": """WITH r AS (SELECT user_id, value > 50 AS i, coalesce(event_type = 'error' AND lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) <> 'error', false) AS s FROM events)
        SELECT CAST(user_id AS VARCHAR) AS stream_id, count(*) AS frames, count(*) FILTER (i) AS invented, count(*) FILTER (i) AS unfiltered, count(*) FILTER (s) AS shrunk FROM r GROUP BY user_id""",
    "qc_evidence": """SELECT CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'path' WHEN doc_id % 7 = 0 THEN 'digest' WHEN doc_id % 5 = 0 THEN 'missing'
        WHEN doc_id % 3 = 0 AND text <> '' THEN 'changed' END AS problem, count(*) AS n FROM documents GROUP BY 1""",
    "qd_detection": f"""{_IMG} SELECT split, count(*) FILTER (doc_id % 9 <> 0) AS images, count(*) FILTER (doc_id % 9 <> 0 AND doc_id % 4 = 0) AS missing_labels,
        count(*) FILTER (doc_id % 9 = 0 AND doc_id % 4 <> 0) AS orphans, CASE WHEN count(*) FILTER (doc_id % 9 <> 0 AND doc_id % 4 = 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status
        FROM img GROUP BY split""",
    "s21_pages": r"""SELECT page_id, replace(url, '\', '/') AS url, CASE WHEN page_id % 9 <> 0 THEN page_id ELSE -1 END AS id, CASE WHEN page_id % 9 <> 0 THEN concat('p', page_id % 7) ELSE '' END AS name,
        CASE WHEN page_id % 9 <> 0 THEN 3 ELSE 0 END AS boxes FROM pages""",
}

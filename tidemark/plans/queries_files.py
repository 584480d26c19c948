"""Queries that write what a sink writes and read it with its reader, and queries of summaries.

Each query makes its files from a whole table, in a scratch folder that the cluster shares, and returns what the
reader finds there; the SQL takes the same rows from the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import boxes as bx
from tidemark.functions import hashing
from tidemark.functions import text as tx
from tidemark.operators import dedup, joins, merge, metrics, profile, split, verify
from tidemark.plans import tables as t
from tidemark.plans.queries_images import line_errors
from tidemark.sources import chain, listing, readers, sinks, store
from tidemark.sources.folders import scratch

#: documents as frames of a manifest
FRAMES = """
SELECT concat(source, '_', CAST(doc_id AS STRING), '.jpg') AS filename, concat('img/', CAST(doc_id AS STRING), '.jpg') AS path,
       CASE WHEN doc_id % 3 = 0 THEN 'static' ELSE 'video_frame' END AS category, CASE WHEN doc_id % 3 <> 0 THEN concat(source, '_', lang) END AS video_id,
       CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id AS INT) END AS frame_index, CASE WHEN doc_id % 3 <> 0 THEN CAST(n_chars % 50 AS INT) END AS sequence_length,
       CAST(320 + n_chars % 7 AS INT) AS width, CAST(240 + n_chars % 5 AS INT) AS height, CAST(n_chars % 3 AS INT) AS fire_boxes,
       CAST(n_chars % 2 AS INT) AS smoke_boxes, n_chars % 6 = 0 AS is_negative
FROM documents
"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.mapped(spark, sf_dir, FRAMES)


#: documents as images of three datasets, one a layout, with label files of all kinds
TREE = """
SELECT doc_id, doc_id % 3 AS k, CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'valid' ELSE 'test' END AS part,
       concat(source, '_', CAST(doc_id AS STRING)) AS stem, CAST(100 + n_chars % 400 AS INT) AS w, CAST(CASE WHEN doc_id % 23 = 0 THEN 0 ELSE 80 + n_chars % 300 END AS INT) AS h,
       CAST(n_chars % 4 AS INT) AS n, doc_id % 19 = 0 AS broken, doc_id % 17 = 0 AS unlabelled
FROM documents
"""


def s1_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split, a flat and a nested folder of images and labels, written and scanned."""
    rows, root = t.mapped(spark, sf_dir, TREE), scratch(spark, "tree")
    head = F.lit(b"\x89PNG\r\n\x1a\n\x00\x00\x00\x0dIHDR")
    image = F.concat(head, *[F.unhex(F.lpad(F.hex(c), 8, "0")) for c in ("w", "h")])
    line = F.when(F.col("broken"), F.lit("7 .5 .5 .1 .1 \u00e9")).otherwise(F.lit("1 0.5 0.5 0.25 0.125"))
    label = F.encode(F.array_join(F.array_repeat(line, F.col("n")), "\n"), "ISO-8859-1")
    place = F.when(F.col("k") == 0, F.concat("part", F.lit("/"))).when(F.col("k") == 2, F.lit("a/b/")).otherwise(F.lit(""))
    folder = F.concat(F.lit("set"), F.col("k").cast("string"), F.lit("/"), place)
    images = rows.select(F.concat(folder, F.lit("images/"), "stem", F.lit(".PNG")).alias("relative"), image.alias("content"))
    labels = rows.where("NOT unlabelled").select(F.concat(folder, F.lit("labels/"), "stem", F.lit(".txt")).alias("relative"), label.alias("content"))
    listing.write_files(images.unionAll(labels), root)
    found = [readers.scan_dataset(spark, f"{root}/set{k}") for k in range(3)]
    columns = ["dataset", "layout", "split", "filename", "width", "height", "is_corrupt", "is_negative", F.coalesce(F.size("boxes"), F.lit(0)).alias("boxes"), "sequence_id"]
    return found[0].unionAll(found[1]).unionAll(found[2]).select(*columns)


def s10_manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest as JSON lines."""
    path = scratch(spark, "manifest-json")
    sinks.write_manifest_json(_frames(spark, sf_dir), path)
    return _numbered(readers.read_manifest_json(spark, path))


def s11_manifest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest as CSV."""
    path = scratch(spark, "manifest-csv")
    sinks.write_manifest_csv(_frames(spark, sf_dir), path)
    return _numbered(readers.read_manifest_csv(spark, path))


def _numbered(frames: DataFrame) -> DataFrame:
    return frames.na.fill(-1, ["frame_index", "sequence_length"])


def s25_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split lists written and read, none missing."""
    rows = t.images(spark, sf_dir).select("split", "path")
    paths = {s: scratch(spark, f"split-{s}") for s in ("train", "val", "test")}
    for name, path in paths.items():
        sinks.write_split(rows.where(F.col("split") == name), path)
    present = rows.select(F.element_at(F.split("path", "/"), -1).alias("filename"))
    return readers.read_splits(spark, paths, present)


def s13_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded frames as compressed JSON lines, an order a frame; each seventh's time goes back."""
    lines = t.table(spark, sf_dir, "lineitem")
    box = F.array("l_quantity", F.lit(1.0), F.col("l_quantity") + 5, F.lit(9.0))
    cells = F.when(F.col("l_linenumber") % 2 == 0, F.concat(box, F.array(F.col("l_linenumber").cast("double"), F.lit(0.5), F.lit(1.0))))
    records = lines.groupBy("l_orderkey").agg(
        F.collect_list(cells).alias("tracks"), F.collect_list(F.when(F.col("l_linenumber") % 2 == 1, F.concat(box, F.array(F.lit(0.25), F.lit(0.0))))).alias("boxes")
    )
    at = F.col("l_orderkey")
    records = records.select(
        F.concat(F.lit("s"), (at % 50).cast("string")).alias("stream_id"), at.alias("frame_index"),
        (at / 8 - F.when(at % 7 == 0, 1000).otherwise(0)).alias("timestamp_sec"), F.array(F.lit(640), F.lit(480)).alias("image_size"),
        F.when(at % 5 == 0, "estimated").otherwise("presentation_timestamp").alias("timestamp_quality"), "boxes", "tracks",
    )
    path = scratch(spark, "records")
    records.write.option("compression", "gzip").json(path)
    found = readers.read_frames(spark, path)
    return found.groupBy("stream_id", "kind").agg(
        F.count("*").alias("n"), F.count_if(~F.col("exact_time")).alias("estimated"), F.count_if(~F.col("in_order")).alias("back"),
        F.coalesce(F.sum("track_id"), F.lit(0)).alias("ids"), F.sum("x2").alias("right"), F.sum("conf").alias("conf"),
    )


def s16_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found videos and manifest rows; the manifest wins."""
    orders = t.table(spark, sf_dir, "orders")
    found = orders.select(F.col("o_custkey").alias("path"), F.lit("found").alias("origin")).distinct()
    listed = t.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.col("c_name").alias("origin"))
    return readers.discover_videos(found, listed)


def s13_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sealed lines of ten streams, some then changed or taken away, and what is found out about it."""
    events = t.table(spark, sf_dir, "events")
    lines = events.select((F.col("event_id") % 10).cast("string").alias("stream_id"), F.concat_ws("|", "event_id", "user_id", "event_type").alias("line"), "event_id")
    path = scratch(spark, "sealed")
    chain.seal(lines, ["event_id"]).write.json(path)
    sealed = spark.read.schema(chain.SEALED).json(path)
    n = F.col("n")
    spoilt = sealed.where("n % 97 <> 50").withColumn("line", F.when(n % 89 == 7, F.concat("line", F.lit("!"))).otherwise(F.col("line")))
    return chain.problems(spoilt, chain.summary(sealed), segment=64)


def k17_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made twice under one signature and once under another; hit: it was there."""
    where, events = scratch(spark, "cache"), t.table(spark, sf_dir, "events")
    out = []
    for least in (0, 0, 50):
        key = store.signature(table="events", least=least, code=1)
        made, hit = store.cached(spark, where, key, lambda least=least: events.where(F.col("value") > least).groupBy("event_type").agg(F.count("*").alias("n")))
        out.append(made.select(F.lit(least).alias("least"), F.lit(hit).alias("hit"), "event_type", "n"))
    return out[0].unionAll(out[1]).unionAll(out[2])


def s18_materialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files of two folders; what the manifest names is located by digest, published, materialised and hashed again."""
    docs = t.table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found, kept = scratch(spark, "found"), store.Store(scratch(spark, "store"))
    for folder, where in (("a", "doc_id % 3 <> 0"), ("b", "doc_id % 2 = 0 OR doc_id % 3 = 0")):
        content = F.when((F.col("doc_id") % 6 == 2) & F.lit(folder == "a"), "old").otherwise(F.col("text"))
        files = docs.where(where).select(F.concat(F.lit(f"{folder}/"), "name").alias("relative"), content.cast("binary").alias("content"))
        listing.write_files(files, found)
    taken = store.copies(docs.select("name", F.sha2("text", 256).alias("sha256")), store.digests(spark, found))
    out = scratch(spark, "materialised")
    kept.publish(taken, key := store.signature(table="documents"))
    kept.materialise(spark, key, out)
    again = store.digests(spark, out).select("name", F.col("sha256").alias("written"), "length")
    place = F.substring_index(F.substring("path", F.length(F.lit(found)) - F.length("path") + 1, 1 << 20), "/", 2)
    return taken.join(again, "name").select("name", "sha256", (F.col("written") == F.col("sha256")).alias("same"), "length", F.right(place, F.lit(1)).alias("folder"))


def s19_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each part by digest, folders before archives."""
    parts = t.table(spark, sf_dir, "part")
    digest = F.sha2(F.col("p_name"), 256)
    manifest = parts.select(F.col("p_partkey").alias("name"), digest.alias("sha256"))
    copies = parts.where("p_partkey % 7 <> 0").withColumn("copy", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("z.zip"))))
    rows = copies.select(
        F.concat_ws("/", "copy", "p_partkey").alias("path"), F.col("p_partkey").alias("name"), (F.col("copy") == "z.zip").alias("is_archive"),
        F.when((F.col("p_partkey") % 5 == 0) & (F.col("copy") != "z.zip"), "x").when(F.col("p_partkey") % 11 == 0, "y").otherwise(digest).alias("sha256"),
    )
    return readers.bundle(manifest, rows).select("name", "path", "problem")


def s23_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs of a CSV, whole, without the last one and with one twice; whether they are 1 to the last supplier's number."""
    path = scratch(spark, "epochs")
    supplier = t.table(spark, sf_dir, "supplier")
    rows = supplier.select((F.col("s_suppkey") + 1).alias("epoch"), F.col("s_acctbal").alias("loss"))
    rows.write.option("header", "true").csv(path)
    cells = readers.read_cells(spark, path).withColumn("epoch", tx.integer(F.col("epoch")))
    n = supplier.agg(F.max("s_suppkey") + 1).first()[0]
    cut, twice = cells.where(F.col("epoch") < n), cells.where(F.col("epoch") < n).unionAll(cells.where("epoch = 1"))
    found = [readers.complete_epochs(x, n).select(F.lit(name).alias("given"), "complete") for name, x in (("whole", cells), ("cut", cut), ("twice", twice))]
    return found[0].unionAll(found[1]).unionAll(found[2])


def k16_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of an evaluation, written and read: box counts of reviewed clips beside the number of clips and variants."""
    path = scratch(spark, "evaluation")
    clips = t.mapped(spark, sf_dir, t.CLIPS.replace("SELECT ", "SELECT o_orderkey, ", 1))
    counts = {"reviewed_frames": 4, "box_tp": 11, "box_fp": 7, "box_fn": 5}
    clips = clips.select("*", F.col("o_orderkey").cast("string").alias("clip"), *[(F.col("o_orderkey") % m).alias(c) for c, m in counts.items()]).drop("o_orderkey")
    sinks.write_evaluation(clips, path)
    boxes = spark.read.option("header", "true").option("inferSchema", "true").csv(f"{path}/iou")
    sums = boxes.groupBy("variant").agg(
        F.count("*").alias("clips"), *[F.sum(c).cast("long").alias(c) for c in ("box_tp", "box_fp", "box_fn")], F.round(F.sum("precision"), 6).alias("precision"),
        F.round(F.sum("recall"), 6).alias("recall"),
    )
    variants = spark.read.option("header", "true").csv(f"{path}/summary").select("variant")
    rows = spark.read.json(f"{path}/per_clip").groupBy("variant").agg(F.count("*").alias("rows"))
    return variants.join(sums, "variant").join(rows, "variant")


def k20_split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as numbered frames of three splits; counts of adjacent pairs and of those alike, from the files."""
    path, rows = scratch(spark, "split-audit"), t.table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    frames = rows.select(
        F.floor(i / 25).cast("string").alias("prefix"), (i % 25).alias("number"), i.cast("string").alias("name"),
        F.element_at(F.array(*[F.lit(s) for s in ("train", "val", "test")]), (F.floor(i / 2) % 3 + 1).cast("int")).alias("split"), hashing.sign_hash(F.col("embedding")).alias("dhash"),
    )
    sinks.write_split_audit(dedup.adjacent_distances(frames), path, most=26)
    found = spark.read.option("header", "true").option("inferSchema", "true").csv(f"{path}/counts")
    near = spark.read.option("header", "true").option("inferSchema", "true").csv(f"{path}/near").agg(F.count("*").alias("all_near"), F.coalesce(F.min("dhash_distance"), F.lit(-1)).cast("long").alias("least"))
    return found.select("splits", F.col("adjacent").cast("long").alias("adjacent"), F.col("near").cast("long").alias("near")).join(F.broadcast(near))


def s24_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as dataset folders."""
    nations = t.table(spark, sf_dir, "nation")
    kind = F.when(F.col("n_regionkey") == 0, "train/images").when(F.col("n_regionkey") == 1, "images").otherwise("raw")
    return readers.dataset_roots(nations.select(F.concat(F.lit("d/"), F.col("n_name")).alias("root"), F.concat_ws("/", F.lit("d"), "n_name", kind).alias("path")))


def s17_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary a customer segment, read back and put in order."""
    path = scratch(spark, "summaries")
    models = F.element_at(F.array(*[F.lit(m) for m in metrics.MODELS]), (F.col("n") % 3 + 1).cast("int"))
    rows = t.table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 5).alias("n")).agg(F.avg("c_acctbal").alias("v"))
    share = F.round(F.col("v") / 10000, 8)
    rows.select(
        models.alias("model"), F.col("n").alias("seed"), share.alias("tiny_fire_AP"), (share / 2).alias("small_fire_AP"), (share / 4).alias("small_smoke_AP"),
        F.struct(F.struct(share.alias("AP"), (share / 2).alias("AP50")).alias("overall")).alias("normal"), F.col("n").alias("run"),
    ).write.partitionBy("run").json(path)
    wanted = [(metrics.MODELS[i % 3], i) for i in range(5)]
    return metrics.comparison_rows(readers.run_summaries(spark, path, wanted))


def k12_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are appended where their key is not there yet."""
    path = scratch(spark, "keyframes")
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sinks.write_absent(orders.where("o_orderkey % 2 = 0").withColumn("round", F.lit(1)), path, ["o_orderkey"])
    sinks.write_absent(orders.where("o_orderkey % 3 = 0").withColumn("round", F.lit(2)), path, ["o_orderkey"])
    return spark.read.parquet(path).groupBy("round").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def k13_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of positive frames."""
    frames = t.mapped(spark, sf_dir, t.STREAM).select(
        F.col("user_id").alias("clip"), F.col("event_id").alias("frame_index"), "ts_sec", F.col("event_id").cast("string").alias("image"),
        (F.col("event_type") == "error").cast("int").alias("n_fire"), (F.col("event_type") == "view").cast("int").alias("n_smoke"),
    )
    return sinks.detection_index(frames)[0]


def k15_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed frames and their images."""
    frames = t.table(spark, sf_dir, "documents").select(F.col("source").alias("clip"), F.col("doc_id").alias("frame_index"), F.col("lang").alias("image"))
    marks = t.table(spark, sf_dir, "documents").join(t.table(spark, sf_dir, "labels"), "doc_id")
    marks = marks.select(F.col("source").alias("clip"), F.col("doc_id").alias("frame_index"), (F.col("quality") == 1).alias("reviewed"))
    return sinks.reviewed_frames(frames, marks)


def k21_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells guarded for spreadsheets, and text escaped for pages."""
    rows = t.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    cell = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "a", "@", "&<'\">", "-")]), (F.col("doc_id") % 6 + 1).cast("int")), F.col("source"))
    return rows.select("doc_id", tx.guarded_cell(cell).alias("cell"), sinks.html_text(cell).alias("html"), sinks.script_json(cell).alias("script"))


def k22_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as lines of text by image."""
    rows = t.boxes(spark, sf_dir).groupBy("image", "ord").agg(F.min("cls").alias("cls"), F.min("conf").alias("conf"))
    rows = rows.select("image", "ord", "cls", *[(F.col("ord") / k).alias(c) for c, k in (("x_center", 8), ("y_center", 16), ("width", 32), ("height", 64))], (F.floor(F.col("conf") * 4) / 4).alias("conf"))
    return sinks.prediction_lines(rows)


def a11_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a verification over documents as frames and order lines as labels."""
    frames = _frames(spark, sf_dir)
    path = F.concat(F.lit("img/"), (F.col("l_orderkey") % 4000).cast("string"), F.lit(".jpg"))
    checked = bx.validated_lines(t.mapped(spark, sf_dir, t.LINES).select(path.alias("path"), "line"), "line", bx.V1).select("path", "checked")
    criteria = verify.unique_and_typed(frames).unionAll(verify.one_resolution(frames))
    return verify.verification_summary(frames, checked, criteria)


def k9_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9, M3: new review items over earlier ones."""
    checked = t.mapped(spark, sf_dir, t.LINES).select("path", bx.validated_line(F.col("line"), bx.V1).alias("checked"))
    items = verify.review_items(checked)
    before = t.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("l/"), F.col("o_orderkey").cast("string")).alias("path"), F.lit("invalid_class_id").alias("reason"), F.lit(0).cast("bigint").alias("lines"),
        F.lit("old").alias("severity"),
    )
    return verify.merged_review(items, before).groupBy("reason", "severity").agg(F.count("*").alias("n"), F.sum("lines").alias("lines"))


def a16_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("subset"), F.col("o_custkey").alias("frames"), (F.col("o_orderkey") % 10).alias("keyframes"),
        (F.col("o_orderkey") % 10).alias("images"), F.when(F.col("o_orderkey") % 13 == 0, 0).otherwise(F.col("o_orderkey") % 10).alias("label_files"),
    )
    return verify.annotation_totals(rows)


def a17_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("clip"), (F.col("o_orderstatus") == "F").alias("is_negative"), (F.col("o_orderkey") % 9).alias("prediction_frames"),
        (F.col("o_orderkey") % 4).alias("predicted_boxes"), (F.col("o_orderkey") % 3).alias("new_flags"),
    )
    return verify.flag_report(rows)


def o5_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's box of the greatest confidence, the lowest line on ties."""
    rows = t.boxes(spark, sf_dir).groupBy("image", "ord").agg(F.max("conf").alias("conf"))
    return profile.best_per_frame(rows, ["image"], "conf", ["ord"])


def o4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty groups of equal texts, as the report lists them."""
    found = dedup.exact_duplicates(t.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), F.col("source").alias("split")), "sha256", "split")
    return profile.first_rows(found.withColumn("splits", F.array_join("splits", ",")), 30, "sha256")


def x25_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both gradient hashes of vectors as 8 x 9 grey values; equal neighbours set neither."""
    grey = F.transform(F.concat("embedding", "embedding"), lambda v: F.floor(v * 8))
    rows = t.table(spark, sf_dir, "embeddings").select("vec_id", F.slice(grey, 1, 72).alias("g"))
    rising, falling = hashing.gradient_hash(F.col("g")), hashing.gradient_hash(F.col("g"), rising=False)
    return rows.select("vec_id", F.bit_count(rising).alias("rising"), F.bit_count(falling).alias("falling"), hashing.hamming(rising, falling).alias("apart"))


def j13_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and whether they have a label."""
    labels = t.table(spark, sf_dir, "labels")
    return joins.completed(t.table(spark, sf_dir, "documents").select("doc_id", "lang"), labels.select("doc_id"), "doc_id")


def j17_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first order."""
    orders = t.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return joins.first_match(t.table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "o_orderkey")


def m5_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: the first broken rule of each review entry."""
    n = F.col("l_linenumber")
    issue = F.when(n == 3, "nonsense").when(n == 4, "false_positive")
    entries = t.table(spark, sf_dir, "lineitem").select(
        merge.valid_annotation(F.lit(100), (F.col("l_partkey") % 120 - 10).cast("int"), (F.col("l_quantity") * 11).cast("int"), issue).alias("problem")
    )
    return entries.groupBy("problem").agg(F.count("*").alias("n"))


def m10_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("clip"), F.when(F.col("o_orderkey") % 3 == 0, "flag").otherwise("annotation").alias("kind"), (F.col("o_orderkey") % 2 == 0).alias("reviewed")
    )
    return merge.review_status(rows)


def g7_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hold-out set and a partitioned rest: usable rows of each category split four to one, videos whole."""
    frames = _frames(spark, sf_dir).withColumn("is_corrupt", F.col("width") == 320)
    made = split.prepared(frames.where("frame_index % 2 = 0"), frames.where("frame_index % 2 = 1 OR frame_index IS NULL"))
    videos = made.where("video_id IS NOT NULL AND frame_index % 2 = 1 AND NOT is_corrupt").groupBy("video_id").agg(F.count_distinct("split").alias("n"))
    kinds = made.groupBy(F.when(F.col("frame_index") % 2 == 0, "holdout").otherwise(F.col("category")).alias("part"), F.col("split") == "quarantine")
    found = kinds.agg(F.count("*").alias("n")).toDF("part", "quarantine", "n")
    return found.unionAll(videos.agg(F.lit("videos in two splits"), F.lit(False), F.count_if(F.col("n") > 1)))


def ac9_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AC9: what is wrong with a configuration for each region's number of nations."""
    counts = t.table(spark, sf_dir, "nation").groupBy("n_regionkey").count()
    rows = []
    for r in counts.collect():  # one row a region
        config = {"train": "a", "val": "b", "nc": 2 if r["n_regionkey"] else r["count"], "names": {"0": "fire", "1": "smoke"} if r["n_regionkey"] % 2 else ["smoke", "fire"]}
        rows.append((r["n_regionkey"], ",".join(verify.config_problems(config))))
    return spark.createDataFrame(rows, "n_regionkey int, problems string")


QUERIES = {
    f.__name__: f
    for f in (
        s1_scanned, s10_manifest_json, s11_manifest_csv, s25_splits, s13_recorded, s13_chain, s16_videos, s18_materialised, k17_cached, s19_bundle, s23_epochs, s24_roots, s17_runs,
        k12_absent, k13_index, k15_reviewed, k16_evaluation, k20_split_audit, k21_guarded, k22_lines, a11_summary, k9_review, a16_totals, a17_flags, o5_best, o4_groups,
        x25_hashes, j13_paired, j17_lookup, m5_payload, m10_status, g7_prepared, ac9_config,
    )
}

_LINE_ERRORS = f"""l AS ({t.duck(t.LINES)}), s AS (SELECT *, string_split(line, ' ') AS p FROM l),
  v AS (SELECT path, l_orderkey, p, len(p) AS n, p[1] AS k, CASE WHEN p[2] <> 'nan' THEN CAST(p[2] AS DOUBLE) END AS x,
    CAST(p[3] AS DOUBLE) AS y, CAST(p[4] AS DOUBLE) AS w, CAST(p[5] AS DOUBLE) AS h FROM s),
  e AS (SELECT *, {line_errors("1e-4", True, False)} AS error FROM v)"""

_NUMBERED = f"""WITH f AS ({t.duck(FRAMES)})
SELECT * REPLACE (coalesce(frame_index, -1) AS frame_index, coalesce(sequence_length, -1) AS sequence_length) FROM f"""

ORACLE_SQL = {
    "s13_chain": """WITH e AS (SELECT event_id % 10 AS s, row_number() OVER (PARTITION BY event_id % 10 ORDER BY event_id) - 1 AS n FROM events),
        k AS (SELECT s, n, lag(n, 1, -1) OVER (PARTITION BY s ORDER BY n) AS p FROM e WHERE n % 97 <> 50),
        f AS (SELECT CAST(s AS VARCHAR) AS stream_id, n, CASE WHEN n <> p + 1 THEN 'missing' WHEN n % 89 = 7 THEN 'changed' END AS problem FROM k),
        c AS (SELECT s, count(*) AS lines, count(*) FILTER (n % 97 <> 50) AS kept, max(n) AS last, max(n) FILTER (n % 97 <> 50) AS end FROM e GROUP BY s)
        SELECT * FROM f WHERE problem IS NOT NULL UNION ALL SELECT CAST(s AS VARCHAR), kept, 'cut' FROM c WHERE kept <> lines""",
    "k17_cached": """SELECT least, hit, event_type, count(*) AS n FROM events, (VALUES (0, false), (0, true), (50, false)) v(least, hit) WHERE value > least GROUP BY ALL""",
    "s18_materialised": """SELECT concat(source, '/', doc_id, '.txt') AS name, sha256(text) AS sha256, true AS same, strlen(text) AS length,
        CASE WHEN doc_id % 3 <> 0 AND NOT (doc_id % 6 = 2 AND text <> 'old') THEN 'a' ELSE 'b' END AS folder FROM documents""",
    "s1_scanned": f"""WITH f AS ({t.duck(TREE)}), g AS (SELECT *, CASE WHEN k <> 0 THEN 'all' WHEN part = 'valid' THEN 'val' ELSE part END AS split,
          CASE WHEN unlabelled OR broken THEN 0 ELSE n END AS boxes FROM f)
        SELECT concat('set', k) AS dataset, CASE k WHEN 0 THEN 'split' WHEN 1 THEN 'flat' ELSE 'recursive' END AS layout, split, concat(stem, '.PNG') AS filename,
          w AS width, h AS height, h = 0 OR (broken AND n > 0 AND NOT unlabelled) AS is_corrupt, boxes = 0 AS is_negative, boxes,
          concat('set', k, '_', split, '_', split_part(stem, '_', 1)) AS sequence_id FROM g""",
    "s10_manifest_json": _NUMBERED,
    "s11_manifest_csv": _NUMBERED,
    "s25_splits": f"WITH i AS ({t.duck(t.IMAGES)}) SELECT path, split, split_part(path, '/', -1) AS filename FROM i",
    "s13_recorded": """WITH f AS (SELECT l_orderkey AS k, concat('s', l_orderkey % 50) AS stream_id, l_orderkey / 8 - CASE WHEN l_orderkey % 7 = 0 THEN 1000 ELSE 0 END AS ts FROM lineitem GROUP BY l_orderkey),
        o AS (SELECT *, coalesce(ts <= lag(ts) OVER (PARTITION BY stream_id ORDER BY k), false) AS back FROM f)
        SELECT stream_id, CASE WHEN l_linenumber % 2 = 0 THEN 'track' ELSE 'box' END AS kind, count(*) AS n, count(*) FILTER (k % 5 = 0) AS estimated, count(*) FILTER (back) AS back,
          CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE 0 END) AS BIGINT) AS ids, sum(l_quantity + 5) AS "right", sum(CASE WHEN l_linenumber % 2 = 0 THEN 0.5 ELSE 0.25 END)::DOUBLE AS conf
        FROM o JOIN lineitem ON l_orderkey = k GROUP BY ALL""",
    "s16_videos": """SELECT coalesce(c_custkey, o_custkey) AS path, coalesce(c_name, 'found') AS origin
        FROM (SELECT DISTINCT o_custkey FROM orders) FULL JOIN customer ON c_custkey = o_custkey""",
    "s19_bundle": """SELECT p_partkey AS name, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 11 <> 0 THEN concat('z.zip/', p_partkey) END
          WHEN p_partkey % 11 <> 0 THEN concat('a/', p_partkey) END AS path,
        CASE WHEN p_partkey % 7 = 0 THEN 'missing' WHEN p_partkey % 11 = 0 THEN 'changed' END AS problem FROM part""",
    "s23_epochs": """WITH e AS (SELECT s_suppkey + 1 AS k, max(s_suppkey + 1) OVER () AS n FROM supplier)
        SELECT 'whole' AS given, count(DISTINCT k) = max(n) AND count(*) = max(n) AND min(k) = 1 AS complete FROM e UNION ALL SELECT 'cut', false UNION ALL SELECT 'twice', false""",
    "k16_evaluation": """WITH c AS (SELECT o_orderpriority AS variant, o_orderkey % 4 AS r, o_orderkey % 11 AS tp, o_orderkey % 7 AS fp, o_orderkey % 5 AS fn FROM orders)
        SELECT variant, count(*) FILTER (r > 0) AS clips, CAST(sum(tp) FILTER (r > 0) AS BIGINT) AS box_tp, CAST(sum(fp) FILTER (r > 0) AS BIGINT) AS box_fp,
          CAST(sum(fn) FILTER (r > 0) AS BIGINT) AS box_fn, round(sum(tp / nullif(tp + fp, 0)) FILTER (r > 0), 6) AS precision,
          round(sum(tp / nullif(tp + fn, 0)) FILTER (r > 0), 6) AS recall, count(*) AS rows FROM c GROUP BY variant""",
    "k20_split_audit": """WITH e AS (SELECT vec_id, vec_id // 25 AS p, vec_id % 25 AS i, ['train', 'val', 'test'][vec_id // 2 % 3 + 1] AS s, list_transform(embedding[1:64], lambda v: v > 0) AS b FROM embeddings),
        d AS (SELECT array_to_string(list_sort([x.s, y.s]), '+') AS splits, len(list_filter(list_zip(x.b, y.b), lambda z: z[1] <> z[2])) AS d FROM e x JOIN e y ON x.p = y.p AND x.i + 1 = y.i AND x.s <> y.s)
        SELECT splits, count(*) AS adjacent, count(*) FILTER (d <= 26) AS near, (SELECT count(*) FROM d WHERE d <= 26) AS all_near,
          (SELECT coalesce(min(d), -1) FROM d WHERE d <= 26) AS least FROM d GROUP BY splits""",
    "s24_roots": """WITH k AS (SELECT concat('d/', n_name) AS root, CAST(CASE n_regionkey WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS INT) AS kind FROM nation)
        SELECT root, kind, CAST(row_number() OVER (ORDER BY kind, root) AS INT) AS place FROM k""",
    "s17_runs": """WITH v AS (SELECT c_custkey % 5 AS n, round(avg(c_acctbal) / 10000, 8) AS v FROM customer GROUP BY 1)
        SELECT ['plain', 'adaptive', 'dense'][n % 3 + 1] AS model, n AS seed, round(100 * v, 6) AS "tiny_fire_AP", round(100 * (v / 2), 6) AS "small_fire_AP", round(100 * (v / 4), 6) AS "small_smoke_AP",
          round(100 * v, 6) AS "overall_AP", round(100 * (v / 2), 6) AS "overall_AP50" FROM v""",
    "k12_absent": """SELECT 1 AS round, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey % 2 = 0
        UNION ALL SELECT 2, count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0""",
    "k13_index": f"""WITH s AS ({t.STREAM}), m AS (SELECT *, CAST(ts_sec * 1000 AS BIGINT) AS m FROM s WHERE event_type IN ('error', 'view'))
        SELECT user_id AS clip, event_id AS frame_index, format('{{:02d}}:{{:02d}}:{{:02d}}.{{:03d}}', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) AS clock,
          CAST(event_id AS VARCHAR) AS image, CAST(event_type = 'error' AS INT) AS n_fire, CAST(event_type = 'view' AS INT) AS n_smoke FROM m""",
    "k15_reviewed": "SELECT source AS clip, doc_id AS frame_index, lang AS image, true AS reviewed FROM documents JOIN labels USING (doc_id) WHERE quality = 1",
    "k21_guarded": r"""WITH c AS (SELECT doc_id, concat(['=', '+', 'a', '@', '&<''">', '-'][doc_id % 6 + 1], source) AS c FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, CASE WHEN c[1] IN ('=', '+', '@', '-') THEN concat('''', c) ELSE c END AS cell,
          replace(replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html,
          replace(replace(replace(c, '&', '\u0026'), '<', '\u003c'), '>', '\u003e') AS script FROM c""",
    "k22_lines": f"""WITH b AS ({t.BOXES}), g AS (SELECT image, ord, min(cls) AS cls, floor(min(conf) * 4) / 4 AS conf FROM b GROUP BY ALL)
        SELECT image, string_agg(format('{{}} {{:.6f}} {{:.6f}} {{:.6f}} {{:.6f}} {{:.6f}}', cls, ord / 8, ord / 16, ord / 32, ord / 64, conf), chr(10) ORDER BY ord) AS lines, count(*) AS n FROM g GROUP BY image""",
    "a11_summary": f"""WITH {_LINE_ERRORS}, f AS ({t.duck(FRAMES)}), p AS (SELECT DISTINCT concat('img/', l_orderkey % 4000, '.jpg') AS path FROM e),
        j AS (SELECT (SELECT count(*) FROM (SELECT filename FROM f GROUP BY 1 HAVING count(*) > 1)) + (SELECT count(*) FROM f WHERE (video_id IS NULL) <> (frame_index IS NULL)) AS a,
          (SELECT count(*) FROM (SELECT video_id FROM f WHERE video_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT (width, height)) > 1)) AS b)
        SELECT (SELECT count(*) FROM f) AS total_images, (SELECT count(*) FROM f WHERE category = 'video_frame') AS video_frames, (SELECT count(*) FROM f WHERE category <> 'video_frame') AS static_images,
          (SELECT count(DISTINCT video_id) FROM f) AS video_sequences, (SELECT count(*) FROM f ANTI JOIN p USING (path)) AS negative_frames,
          (SELECT count(*) FROM e WHERE error IS NULL AND p[1] = '0') AS fire_boxes, (SELECT count(*) FROM e WHERE error IS NULL AND p[1] = '1') AS smoke_boxes,
          (SELECT count(*) FROM e WHERE error IS NOT NULL) AS invalid_boxes, (SELECT count(*) FROM e WHERE error = 'class') AS invalid_classes,
          CAST(a = 0 AS INT) + CAST(b = 0 AS INT) AS passed, CAST(a > 0 AS INT) + CAST(b > 0 AS INT) AS failed, 0 AS skipped,
          (SELECT count(*) FROM (SELECT DISTINCT l_orderkey % 4000, error = 'class' FROM e WHERE error IS NOT NULL)) AS manual_review_items FROM j""",
    "k9_review": f"""WITH {_LINE_ERRORS}, n AS (SELECT path, CASE WHEN error = 'class' THEN 'invalid_class_id' ELSE 'out_of_bounds_bbox' END AS reason, count(*) AS lines FROM e WHERE error IS NOT NULL GROUP BY ALL),
        o AS (SELECT concat('l/', o_orderkey) AS path, 'invalid_class_id' AS reason FROM orders),
        m AS (SELECT reason, CASE WHEN reason = 'invalid_class_id' THEN 'high' ELSE 'medium' END AS severity, lines FROM n
          UNION ALL SELECT reason, 'old', 0 FROM o ANTI JOIN n USING (path, reason))
        SELECT reason, severity, count(*) AS n, CAST(sum(lines) AS BIGINT) AS lines FROM m GROUP BY ALL""",
    "a16_totals": """SELECT o_orderpriority AS subset, count(*) AS videos, CAST(sum(o_custkey) AS BIGINT) AS frames, CAST(sum(o_orderkey % 10) AS BIGINT) AS keyframes,
        CAST(sum(CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_orderkey % 10 END) AS BIGINT) AS label_files, count(*) FILTER (o_orderkey % 13 = 0 AND o_orderkey % 10 <> 0) AS incomplete
        FROM orders GROUP BY ROLLUP (o_orderpriority)""",
    "a17_flags": """WITH n AS (SELECT * FROM orders WHERE o_orderstatus = 'F')
        SELECT count(*) AS negative_clips, count(*) FILTER (o_orderkey % 4 > 0) AS negative_clips_with_predictions, CAST(sum(o_orderkey % 9) AS BIGINT) AS prediction_frames,
          CAST(sum(o_orderkey % 4) AS BIGINT) AS predicted_boxes, CAST(sum(o_orderkey % 3) AS BIGINT) AS new_flags, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS remaining_positive_clips FROM n""",
    "o5_best": f"WITH b AS ({t.BOXES}), m AS (SELECT image, ord, max(conf) AS conf FROM b GROUP BY ALL) SELECT image, arg_min(ord, (-conf, ord)) AS ord, max(conf) AS conf FROM m GROUP BY image",
    "o4_groups": """SELECT sha256(text) AS sha256, count(*) AS copies, string_agg(DISTINCT source, ',' ORDER BY source) AS splits
        FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1 ORDER BY 1 LIMIT 30""",
    "x25_hashes": """WITH g AS (SELECT vec_id, list_transform((embedding || embedding)[1:72], lambda v: floor(CAST(v AS FLOAT) * 8)) AS g FROM embeddings),
        p AS (SELECT vec_id, list_transform(range(64), lambda i: g[(i // 8) * 9 + i % 8 + 2] - g[(i // 8) * 9 + i % 8 + 1]) AS d FROM g)
        SELECT vec_id, CAST(len(list_filter(d, lambda x: x > 0)) AS INT) AS rising, CAST(len(list_filter(d, lambda x: x < 0)) AS INT) AS falling,
          CAST(len(list_filter(d, lambda x: x <> 0)) AS INT) AS apart FROM p""",
    "j13_paired": "SELECT doc_id, lang, doc_id IN (SELECT doc_id FROM labels) AS complete FROM documents",
    "j17_lookup": "SELECT c_custkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "m5_payload": """SELECT CASE WHEN l_partkey % 120 - 10 < 0 OR l_partkey % 120 - 10 >= 100 THEN 'frame_index' WHEN l_quantity * 11 > 500 THEN 'too many boxes'
        WHEN l_linenumber = 3 THEN 'issue' END AS problem, count(*) AS n FROM lineitem GROUP BY 1""",
    "m10_status": """SELECT o_custkey AS clip, count(*) FILTER (o_orderkey % 3 = 0) AS flags, count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0) AS reviewed_frames
        FROM orders GROUP BY o_custkey""",
    "g7_prepared": f"""WITH f AS ({t.duck(FRAMES)}) SELECT CASE WHEN frame_index % 2 = 0 THEN 'holdout' ELSE category END AS part, width = 320 AS quarantine, count(*) AS n FROM f GROUP BY ALL
        UNION ALL SELECT 'videos in two splits', false, 0""",
    "ac9_config": """SELECT n_regionkey, concat_ws(',', 'no test', CASE WHEN n_regionkey = 0 AND count(*) <> 2 THEN 'nc' END, CASE WHEN n_regionkey % 2 = 0 THEN 'names' END) AS problems FROM nation GROUP BY n_regionkey""",
}

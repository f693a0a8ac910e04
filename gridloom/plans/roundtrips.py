"""Queries over sources and sinks: each writes a table or files, reads them again, and returns what it read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import cleaning, labels, tiling
from ..sources import cache, pixels, readers, writers
from ..sources.scratch import scratch, spread, written
from . import fixture as X
from .catalogue import _SEEN, TILINGS, query, tile_sql
from .fixture import sql

# Annotation documents


def _document(spark, d):
    folder = scratch(spark, "coco")
    kept = cleaning.cleaned(X.dirty_images(spark, d), X.dirty_annotations(spark, d), X.categories(spark))
    boxes = kept.select("id", "image_id", "category_id", F.array(*[F.col(c).cast("double") for c in "xywh"]).alias("bbox"), F.col("area").cast("double").alias("area"), F.lit(0).alias("iscrowd"))
    writers.write_coco_file(folder, X.dirty_images(spark, d).select("id", "file_name", "width", "height"), boxes, X.categories(spark))
    return readers.coco(spark, folder)


@query("coco_images", sql("SELECT id, file_name, width, height FROM dimg"))
def _(spark, d):
    return _document(spark, d)["images"]


@query("coco_annotations", sql(_SEEN + " SELECT id, image_id, category_id, round(x1, 6) AS x, round(y1, 6) AS y, round(w1, 6) AS w, round(h1, 6) AS h, round(CASE WHEN area_fixed THEN w1 * h1 ELSE area END, 6) AS area FROM seen WHERE reason IS NULL"))
def _(spark, d):
    box = [F.round(F.col("bbox")[i], 6).alias(c) for i, c in enumerate("xywh")]
    return _document(spark, d)["annotations"].select("id", "image_id", "category_id", *box, F.round("area", 6).alias("area"))


@query("coco_categories", "SELECT i AS id, 'class_' || i AS name FROM range(1, 5) t(i)")
def _(spark, d):
    return _document(spark, d)["categories"]


@query("annotation_files", f"SELECT * FROM (VALUES ('both', '{readers.CLEAN}'), ('raw', '{readers.RAW}'), ('none', NULL)) t(folder, found)")
def _(spark, d):
    root, own = scratch(spark, "folders"), {"both": [readers.RAW, readers.CLEAN], "raw": [readers.RAW], "none": ["other.json"]}
    for folder, names in own.items():
        for n in names:
            writers.write_text(spark, f"{root}/{folder}/{n}", '{"images": []}')
    found = {f: readers.annotation_path(spark, f"{root}/{f}") for f in own}
    return spark.createDataFrame([(f, p and p.rsplit("/", 1)[-1]) for f, p in found.items()], "folder string, found string")


@query("raw_entries", sql("SELECT id, 'img_' || id || '.jpg' AS file_name, 'roof' AS place FROM dimg"))
def _(spark, d):
    folder = scratch(spark, "raw")
    doc = X.images(spark, d).agg(F.collect_list(F.struct(F.col("image_id").alias("id"), "file_name", F.lit("roof").alias("place"))).alias("images")).select(F.to_json(F.struct("images")).alias("value"))
    doc.coalesce(1).write.text(folder)
    return readers.coco_raw(spark, folder, "images").select("id", *[F.get_json_object("entry", f"$.{c}").alias(c) for c in ("file_name", "place")])


# Files


def _exported(spark, d):
    """An empty-looking file of image_id % 50 + 1 bytes for each image, with endings in both cases, and others beside them."""
    folder = scratch(spark, "files")
    name = F.when(F.col("image_id") % 2 == 0, F.col("file_name")).otherwise(F.concat(F.lit("img_"), F.col("image_id").cast("string"), F.lit(".PNG")))
    own = X.images(spark, d).repartition(spread(spark), "image_id").select(name.alias("name"), F.expr("cast(repeat('x', int(image_id % 50 + 1)) as binary)").alias("content"))
    other = X.images(spark, d).filter("image_id % 10 = 0").select(F.concat("file_name", F.lit(".txt")).alias("name"), F.lit(b"x").alias("content"))
    writers.export_files(folder, own.unionByName(other))
    return folder


_NAMED = "CASE WHEN image_id % 2 = 0 THEN file_name ELSE 'img_' || image_id || '.PNG' END AS file_name"


@query("image_listing", sql(f"SELECT {_NAMED}, image_id % 50 + 1 AS bytes FROM img"))
def _(spark, d):
    return readers.image_listing(spark, _exported(spark, d)).select("file_name", "bytes")


@query("source_bytes", sql("SELECT CAST(sum(image_id % 50 + 1) AS BIGINT) AS bytes FROM img WHERE image_id % 2 = 0"))
def _(spark, d):
    return readers.source_bytes(X.images(spark, d), readers.image_listing(spark, _exported(spark, d)))


@query("copied_files", sql("SELECT file_name FROM img WHERE image_id % 6 = 0"))
def _(spark, d):
    target = scratch(spark, "copies")
    writers.copy_split(_exported(spark, d), target, X.images(spark, d).filter("image_id % 3 = 0").select("file_name"))
    return readers.image_listing(spark, target).select("file_name")


def _small_images(spark, d):
    """Colour images of width / 64 by height / 36 points whose bytes follow from the place and the id, as files."""

    def drawn(frames):
        import pandas as pd

        byte = np.arange(1 << 16).astype(np.uint8)  # numbers modulo 256
        for pdf in frames:
            out = []
            for i, w, h in zip(pdf["image_id"], pdf["width"] // 64, pdf["height"] // 36, strict=True):
                at = 7 * np.arange(w)[:, None] + 29 * np.arange(3) + i % 256
                out.append((f"img_{i}.png", pixels.png(byte[13 * np.arange(h)[:, None, None] + at])))
            yield pd.DataFrame(out, columns=["name", "content"])

    folder = scratch(spark, "pixels")
    writers.export_files(folder, X.images(spark, d).select("image_id", "width", "height").repartition(spread(spark), "image_id").mapInPandas(drawn, "name string, content binary"))
    return folder


_POINTS = """, s AS (SELECT image_id, width // 64 AS w, height // 36 AS h FROM img), px AS (SELECT image_id, w, h, unnest(range(w)) AS x FROM s), py AS (SELECT *, unnest(range(h)) AS y FROM px)"""


@query("decoded_sizes", sql("SELECT 'img_' || image_id || '.png' AS file_name, CAST(width // 64 AS INT) AS disk_width, CAST(height // 36 AS INT) AS disk_height FROM img"))
def _(spark, d):
    return readers.decoded(spark, _small_images(spark, d))


@query("decoded_pixels", sql(_POINTS + " SELECT 'img_' || image_id || '.png' AS file_name, CAST(sum((7 * x + 13 * y + image_id) % 256 * (x + 1)) AS BIGINT) AS blue, CAST(sum((7 * x + 13 * y + 58 + image_id) % 256 * (x + 1)) AS BIGINT) AS red FROM py GROUP BY image_id"))
def _(spark, d):
    def weighed(frames):
        first = lambda p, w: int(np.frombuffer(p, np.uint8)[::3].reshape(-1, w).sum(axis=0, dtype=np.int64) @ np.arange(1, w + 1))
        for pdf in frames:
            own = {k: [first(p, w) for p, w in zip(pdf[c], pdf["width"], strict=True)] for k, c in (("blue", "own"), ("red", "pixels"))}
            yield pdf[["file_name"]].assign(**own)

    loaded = pixels.load(spark, _small_images(spark, d)).withColumn("own", F.col("pixels"))
    return pixels.rgb(loaded).mapInPandas(weighed, "file_name string, blue long, red long")


@query("rebuilt_pixels", sql("SELECT 'img_' || image_id || '.png' AS file_name, TRUE AS same FROM img"))
def _(spark, d):
    """Each small image cut into four overlapping tiles and put together again, from strips of a few rows."""
    from ..operators import reconstruct

    own = pixels.load(spark, _small_images(spark, d)).withColumn("image_id", F.regexp_extract("file_name", "[0-9]+", 0).cast("long"))
    half = lambda c: (F.floor(F.col(c) / 2) + 1).cast("int")
    size = [F.col("width"), F.col("height"), half("width").alias("tile_width"), half("height").alias("tile_height")]
    at = F.array(*[F.struct(*size, x.cast("int").alias("x"), y.cast("int").alias("y")) for x in (F.lit(0), F.col("width") - half("width")) for y in (F.lit(0), F.col("height") - half("height"))])
    again = reconstruct.rebuild(pixels.cut(own.withColumn("tiles", at)), strip_bytes=4096)
    known = written(own.select("image_id", "file_name", F.sha2("pixels", 256).alias("sha")), "digests")
    wrong = reconstruct.mismatches(known, again).withColumn("wrong", F.lit(True))
    return known.join(wrong, "image_id", "left").select("file_name", F.col("wrong").isNull().alias("same"))


@query("label_files", sql("SELECT 'img_' || image_id || '.txt' AS sample_name, count(*) AS n, CAST(sum(x1) AS BIGINT) AS x1, CAST(sum(y2) AS BIGINT) AS y2 FROM (SELECT image_id, 2 * x - w AS x1, 2 * y + h AS y2 FROM ann) GROUP BY image_id"))
def _(spark, d):
    folder = scratch(spark, "labels")
    line = F.concat_ws(" ", (F.col("category_id") - 1).cast("string"), *[F.col(c).cast("string") for c in "xywh"])
    own = X.annotations(spark, d).groupBy(F.concat(F.lit("img_"), F.col("image_id").cast("string")).alias("sample_name")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    empty = X.images(spark, d).select(F.concat(F.lit("empty_"), F.col("image_id").cast("string")).alias("sample_name"), F.lit(None).cast("string").alias("text")).filter("sample_name LIKE '%0'")
    writers.export_labels(folder, own.unionByName(empty))
    boxes = labels.corners_of(readers.parsed_labels(readers.label_lines(spark, folder)))
    return boxes.groupBy("sample_name").agg(F.count(F.lit(1)).alias("n"), F.sum(2 * F.col("x1")).cast("long").alias("x1"), F.sum(2 * F.col("y2")).cast("long").alias("y2"))


# Tables


@query("cached_detections", sql("SELECT det_id, image_id, fold, label, score FROM det"))
def _(spark, d):
    path = scratch(spark, "detections")
    own = X.detections(spark, d).withColumns({"split": F.lit("test"), "arch": F.lit("made"), "dataset": F.lit("parts"), "image": F.concat(F.lit("img_"), F.col("image_id").cast("string"))})
    writers.write_detections(own, path)

    def never():
        raise AssertionError("the cache exists")

    return readers.cached(spark, path, never).select("det_id", "image_id", F.col("fold").cast("long").alias("fold"), "label", "score")


@query("collected_in_runs", sql("SELECT det_id, image_id, fold, label, score FROM det"))
def _(spark, d):
    """A run over three folds, one over all that dies half-way, and one over all."""
    path, own = scratch(spark, "growing"), X.detections(spark, d)
    made = own.withColumns({"split": F.lit("test"), "arch": F.lit("made"), "dataset": F.lit("parts"), "fold": F.col("fold").cast("int"), "image": F.concat(F.lit("img_"), F.col("image_id").cast("string"))})
    wanted = X.images(spark, d).select(F.lit("test").alias("split"), F.lit("made").alias("arch"), F.lit("parts").alias("dataset"), F.col("fold").cast("int").alias("fold"), F.concat(F.lit("img_"), F.col("image_id").cast("string")).alias("image"))
    names = [c.split(" ")[0] for c in readers.DETECTION.split(", ")]
    run = lambda todo: made.join(todo, list(cache.KEYS), "left_semi").select(*names)

    def dying(todo):
        return run(todo).withColumn("label", F.when(F.col("det_id") % 1000 == 0, F.raise_error(F.lit("the engine died"))).otherwise(F.col("label")).cast("int"))

    cache.collect(wanted.filter("fold < 3"), path, run)
    try:
        cache.collect(wanted, path, dying)
    except Exception as e:
        if "the engine died" not in str(e):
            raise
    return cache.collect(wanted, path, run).select("det_id", F.expr("cast(substring(image, 5) as bigint)").alias("image_id"), F.col("fold").cast("long").alias("fold"), "label", "score")


@query("encoded_tiles", sql(_POINTS + " SELECT DISTINCT 'img_' || image_id || '_tile_' || t.x || '_' || t.y || '.png' AS file_name, CAST(w - t.x AS INT) AS width, CAST(h - t.y AS INT) AS height, TRUE AS same FROM s, LATERAL (VALUES (0, 0), (w // 2, 0), (w // 2, h // 2)) t(x, y)"))
def _(spark, d):
    """Tiles of each small image encoded, written as files and decoded again: the bytes are those that were cut."""
    own = pixels.load(spark, _small_images(spark, d)).withColumn("image_id", F.regexp_extract("file_name", "[0-9]+", 0).cast("long"))
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    at = F.array(*[F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), (F.col("width") - x).cast("int").alias("tile_width"), (F.col("height") - y).cast("int").alias("tile_height")) for x, y in ((F.lit(0), F.lit(0)), (half("width"), F.lit(0)), (half("width"), half("height")))])
    cut = pixels.cut(own.withColumn("tiles", at))
    name = F.format_string("img_%d_tile_%d_%d.png", "image_id", "x", "y").alias("name")
    folder = scratch(spark, "encoded")
    writers.export_files(folder, pixels.encoded(cut, pixels.png).select(name, F.col("file").alias("content")))
    again = pixels.load(spark, folder).select("file_name", "width", "height", F.sha2("pixels", 256).alias("sha"))
    was = cut.select(name.alias("file_name"), F.sha2("pixels", 256).alias("was"))  # digests move, not pixels
    return again.join(was, "file_name").select("file_name", "width", "height", (F.col("sha") == F.col("was")).alias("same"))


@query("fold_stats_rows", sql("SELECT image_id, width, CASE image_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM img WHERE fold = 2"))
def _(spark, d):
    path = scratch(spark, "stats")
    own = X.images(spark, d).filter("fold = 2").select("image_id", "width", F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("image_id") % 3 + 1).cast("int")).alias("split"))
    writers.write_fold_stats(path, own)
    return readers.fold_stats(spark, f"{path}-old", path).select("image_id", F.col("width").cast("int").alias("width"), "split")


_MADE = ("models", "fold", "precision")


def _results(spark, d):
    return X.images(spark, d).groupBy("fold").agg(F.round(F.avg("width") / 10_000, 6).alias("precision")).select(F.lit("made").alias("models"), F.col("fold").cast("int").alias("fold"), "precision")


@query("csv_results", sql("SELECT 'made' AS models, CAST(fold AS INT) AS fold, round(avg(width) / 10000, 6) AS precision FROM img GROUP BY fold"))
def _(spark, d):
    path = scratch(spark, "csv")
    writers.write_csv(_results(spark, d), path)
    return readers.results(spark, path, "models string, fold int, precision double")


@query("appended_results", sql(", r AS (SELECT 'made' AS models, CAST(fold AS INT) AS fold, round(avg(width) / 10000, 6) AS precision FROM img GROUP BY fold) SELECT * FROM r UNION ALL SELECT * FROM r"))
def _(spark, d):
    path = scratch(spark, "appended")
    writers.append_csv(_results(spark, d), path, ["models", "fold"])
    for _ in range(2):  # the first has another header, so what was there is archived
        writers.append_csv(_results(spark, d), path, list(_MADE))
    return readers.results(spark, path, "models string, fold int, precision double")


@query("overwritten_folds", sql("SELECT image_id, CAST(fold AS INT) AS fold, CASE WHEN fold = 2 THEN 'new' ELSE 'old' END AS state FROM img"))
def _(spark, d):
    path, own = scratch(spark, "folds"), X.images(spark, d).select("image_id", F.col("fold").cast("int").alias("fold"))
    writers.write_folds(own.withColumn("state", F.lit("old")), path)
    writers.write_folds(own.filter("fold = 2").withColumn("state", F.lit("new")), path)
    return spark.read.parquet(path).select("image_id", "fold", "state")


@query("removed_run", "SELECT TRUE AS removed, FALSE AS left_over")
def _(spark, d):
    path = scratch(spark, "run")
    writers.write_csv(_results(spark, d), path)
    return spark.createDataFrame([(writers.remove(spark, path), readers.exists(spark, path))], "removed boolean, left_over boolean")


@query("tile_metadata", sql(tile_sql("asahi") + " SELECT image_id, row_index, column_index, x, y, tile_width, tile_height FROM tl"))
def _(spark, d):
    path = scratch(spark, "tiles")
    writers.write_tiles(tiling.tiles(X.images(spark, d), TILINGS["asahi"]), path)
    return spark.read.json(path).select("image_id", *[F.col(c).cast("int").alias(c) for c in ("row_index", "column_index", "x", "y", "tile_width", "tile_height")])


# Configurations and manifests


def _configs(spark, d, mode):
    path, t = scratch(spark, f"configs-{mode}"), TILINGS[mode]
    writers.slicing_configs(tiling.tile_names(tiling.tiles(X.images(spark, d), t)), t).select(F.col("config").alias("value")).write.text(path)
    return spark.read.json(path)


_SUMS = "count(*) AS tile_count, CAST(sum(x * (column_index + 1)) AS BIGINT) AS xs"


@query("slicing_configs_sahi", sql(tile_sql("sahi") + f""", t AS (SELECT image_id, {_SUMS}, list_sort(list_distinct(list(x))) AS p FROM tl GROUP BY ALL)
SELECT image_id, tile_count, xs, 544 AS stride_x, 96 AS overlap_x, CASE WHEN len(p) >= 2 THEN p[-1] - p[-2] END AS gap_x, round(96 / 640.0::DOUBLE, 6) AS overlap FROM t"""))
def _(spark, d):
    own = _configs(spark, d, "sahi")
    c, xs = F.col, F.aggregate(F.transform("tiles", lambda t: t["x"] * (F.array_position(F.array_sort(F.array_distinct(F.col("tiles")["x"])), t["x"]))), F.lit(0).cast("long"), lambda a, b: a + b)
    ints = {k: c(k).cast("int") for k in ("stride_x", "overlap_x")} | {"gap_x": c("edge_coverage.x.gap_px").cast("int"), "xs": xs, "image_id": c("id_image"), "overlap": F.round(c("overlap_x") / c("tile_size")[0], 6)}
    return own.withColumns(ints).select("image_id", "tile_count", "xs", "stride_x", "overlap_x", "gap_x", "overlap")


@query("slicing_configs_asahi", sql(tile_sql("asahi") + " SELECT image_id, count(*) AS tile_count, max(tile_width) AS tile_width, max(column_index) + 1 AS grid_cols, max(row_index) + 1 AS grid_rows, 0.15::DOUBLE AS overlap_ratio, 'img_' || image_id || '.jpg' AS source_image FROM tl GROUP BY image_id"))
def _(spark, d):
    c = F.col
    return _configs(spark, d, "asahi").select(c("id_image").alias("image_id"), "tile_count", c("tile_size")[0].cast("int").alias("tile_width"), "grid_cols", "grid_rows", "overlap_ratio", "source_image")


@query("saved_overlaps", "SELECT * FROM (VALUES ('ratio', 0.15::DOUBLE), ('pixels', 0.25::DOUBLE)) t(kind, overlap)")
def _(spark, d):
    root = scratch(spark, "saved")
    for kind, config in (("ratio", {"overlap_ratio": 0.15}), ("pixels", {"overlap_x": 160, "tile_size": [640, 640]})):
        writers.write_json(spark, f"{root}/{kind}/slicing_config.json", config)
    return spark.createDataFrame([(k, readers.config_overlap(readers.slicing_config(spark, f"{root}/{k}/slicing_config.json"))) for k in ("ratio", "pixels")], "kind string, overlap double")


@query("fold_files", "SELECT i AS place, 'fold_' || i || '.yaml' AS name, i = 3 AS has_test FROM range(1, 13) t(i)")
def _(spark, d):
    root = scratch(spark, "yaml")
    for i in range(12, 0, -1):
        writers.write_fold_yaml(spark, f"{root}/fold_{i}.yaml", "data", ["a", "b"], test=i == 3)
    rows = [(n, p.rsplit("/", 1)[-1], "test:" in readers.read_text(spark, p)) for n, p in enumerate(readers.folds(spark, f"{root}-old", root), 1)]
    return spark.createDataFrame(rows, "place long, name string, has_test boolean")


@query("next_ids", "SELECT * FROM (VALUES ('some', 12), ('none', 1)) t(folder, next_id)")
def _(spark, d):
    root = scratch(spark, "ids")
    for n in ("3", "11", "x20"):
        writers.write_text(spark, f"{root}/{n}/f", "")
    return spark.createDataFrame([("some", readers.next_id(spark, root)), ("none", readers.next_id(spark, f"{root}-none"))], "folder string, next_id int")


@query("checkpoints", "SELECT * FROM (VALUES ('DETR', 'detr', 'best.pt'), ('Faster', 'faster_rcnn', 'last.pth'), ('YOLOV8N', 'yolo', 'w.pt')) t(model, engine, weights)")
def _(spark, d):
    import json

    from ..operators.inference import engine_of

    root = scratch(spark, "weights")
    for model, name in (("detr", "best.pt"), ("Faster", "last.pth"), ("YOLOV8N", "w.pt"), ("other", "w.pt"), ("YOLOV9", "notes.txt")):
        writers.write_text(spark, f"{root}/w/sahi/model_checkpoints/fold_1/{model}/{name}", "")
    writers.weight_manifests(spark, f"{root}/w", f"{root}/m", "sahi", 1, engine_of)
    rows = []
    for model, folder in (("DETR", "detr"), ("Faster", "Faster"), ("YOLOV8N", "YOLOV8N")):
        engine = json.loads(readers.read_text(spark, f"{root}/m/sahi/fold_1/{folder}/manifest.json"))["engine"]
        rows.append((model, engine, readers.checkpoint(spark, f"{root}/m", "sahi", 1, model).rsplit("/", 1)[-1]))
    return spark.createDataFrame(rows, "model string, engine string, weights string")


@query("dataset_manifest", sql("SELECT fold, count(*) AS n, 'sahi' AS mode FROM img GROUP BY fold"))
def _(spark, d):
    path = f"{scratch(spark, 'manifest')}/manifest.json"
    counts = [r.asDict() for r in X.images(spark, d).groupBy("fold").agg(F.count(F.lit(1)).alias("n")).orderBy("fold").collect()]
    writers.write_json(spark, path, writers.dataset_manifest("sahi", len(counts), ["a"], counts))
    return spark.read.option("multiLine", True).json(path).select(F.inline("folds"), F.col("slicing_mode").alias("mode"))

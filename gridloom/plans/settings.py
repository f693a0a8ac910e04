"""Queries over configuration, splits, result tables and engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import geometry as G
from ..operators import cleaning, inference, splits, stats, suppression, sweep, tiling
from . import fixture as X
from .catalogue import STEPS, TILINGS, _fold_metrics, diou_of, iou_of, kept_sql, query, rounded, sweep_sql, tile_sql
from .fixture import sql

# Configuration

_BLOCK = {"dataset": {"input_path": "in", "output_path": "out/parts"}, "slicing": {"mode": "asahi", "overlap_ratio": 0.2}, "crossfolds": {"n_folds": 3}, "models": ["DETR"]}


@query("config_setups", "SELECT * FROM (VALUES (1, 'parts', 'asahi', 0.2::DOUBLE, 3), (2, 'plain', 'sahi', 0.15::DOUBLE, 5)) t(place, name, mode, overlap, n_folds)")
def _(spark, d):
    files = {"a.yaml": _BLOCK, "b.yaml": {"dataset": {"input_path": "in", "output_path": "out/plain"}}, "c.yaml": {}}
    catalogue = {"setups": [{"name": n, "config": f"{n}.yaml"} for n in "abc"], "setups_to_run": ["a", "b"]}
    inline = config.setups({"processes": [files["a.yaml"], files["b.yaml"]]}, None)
    found = config.setups(catalogue, files.get)
    assert found == inline
    return spark.createDataFrame([(s.index, s.name, s.slicing.mode, s.slicing.overlap_ratio, s.folds.n_folds) for s in found], "place int, name string, mode string, overlap double, n_folds int")


@query("setup_problems", "SELECT * FROM (VALUES ('good', 0), ('mode', 1), ('ratios', 2), ('all', 7)) t(name, problems)")
def _(spark, d):
    bad = {"good": {}, "mode": {"slicing": {"mode": "grid"}}, "ratios": {"crossfolds": {"val_ratio": 1.0, "ioa_threshold": 0.0}},
           "all": {"slicing": {"tile_size": [0, 640], "overlap_ratio": 1.0}, "crossfolds": {"n_folds": 1, "empty_tile_ratio": 2.0}, "inference": {"suppression": "soft", "conf_threshold": 0.0, "batch_size": 0}}}
    rows = []
    for name, parts in bad.items():
        made = {k: kind(**{a: tuple(v) if isinstance(v, list) else v for a, v in parts.get(p, {}).items()}) for k, p, kind in (("slicing", "slicing", config.Slicing), ("folds", "crossfolds", config.Folds), ("inference", "inference", config.Inference))}
        rows.append((name, len(config.Setup(1, "in", "out", **made).problems())))
    return spark.createDataFrame(rows, "name string, problems int")


@query("chosen_names", "SELECT * FROM (VALUES ('YOLOv8n'), ('Faster')) t(name)")
def _(spark, d):
    return spark.createDataFrame([(n,) for n in config.chosen(["DETR", "Faster", "YOLOv8n"], config.wanted(["yolov8N, FASTER"]))], "name string")


@query("canonical_models", "SELECT * FROM (VALUES ('detr', 'DETR', 'SAHI_DETR'), ('FasterRCNN', 'Faster', 'SAHI_Faster'), ('yolov8n', 'YOLOV8N', 'SAHI_YOLOV8N'), ('YOLO', NULL, NULL)) t(given, model, label)")
def _(spark, d):
    rows = []
    for given in ("detr", "FasterRCNN", "yolov8n", "YOLO"):
        try:
            own = config.canonical_model(given)
        except ValueError:
            own = None
        rows.append((given, own, own and config.result_label("sahi", own)))
    return spark.createDataFrame(rows, "given string, model string, label string")


@query("suppression_by_mode", "SELECT * FROM (VALUES ('sahi', 'nms', FALSE), ('none', 'nms', FALSE), ('asahi', 'cluster_diou_nms', TRUE), ('asahi_rect', 'cluster_diou_nms', TRUE)) t(mode, method, whole_image)")
def _(spark, d):
    return spark.createDataFrame([(m, suppression.BY_MODE[m], inference.with_full_image(m)) for m in config.MODES], "mode string, method string, whole_image boolean")


# Tilings


@query("tiles_none", sql("SELECT image_id, 0 AS x FROM img WHERE FALSE"))
def _(spark, d):
    return tiling.tiles(X.images(spark, d), tiling.Tiling("none")).select("image_id", "x")


@query("tiles_unknown_mode", sql(tile_sql("sahi") + " SELECT image_id, x, y FROM tl"))
def _(spark, d):
    return tiling.tiles(X.images(spark, d), tiling.Tiling("hexagons")).select("image_id", "x", "y")


def _redundancy(mode: str) -> None:
    area = "max(tile_width) * max(tile_height)" if mode != "sahi" else str(640 * 640)
    body = f""", one AS (SELECT width, height, min(image_id) AS i FROM img GROUP BY ALL), g AS (SELECT tl.width, tl.height, greatest(0, count(*) * {area} - tl.width * tl.height) AS r FROM tl JOIN one ON image_id = i GROUP BY tl.width, tl.height)
SELECT width, height, round(r / CAST(width * height AS DOUBLE) * 100, 1) AS redundancy_pct FROM g"""

    @query(f"redundancy_{mode}", sql(tile_sql(mode) + body))
    def _(spark, d):
        own = tiling.geometry(X.images(spark, d).select("width", "height").distinct(), TILINGS[mode])
        return own.select("width", "height", F.round(F.col("redundant_pixels") / (F.col("width").cast("long") * F.col("height")) * 100, 1).alias("redundancy_pct"))


    @query(f"redundancy_pct_{mode}", sql(tile_sql(mode) + body.replace("* 100, 1)", "* 100, 6)")))
    def _(spark, d):
        """The operator's own percentage: two digits of the exact one, or null where it strays from that."""
        own = tiling.geometry(X.images(spark, d).select("width", "height").distinct(), TILINGS[mode])
        exact = F.col("redundant_pixels") / (F.col("width").cast("long") * F.col("height")) * 100
        return own.select("width", "height", F.when(F.abs(F.col("redundancy_pct") - exact) <= 0.005 + 1e-9, F.round(exact, 6)).alias("redundancy_pct"))


for _mode in TILINGS:
    _redundancy(_mode)


@query("resize_scales", sql("SELECT DISTINCT width, height, round(640 / CAST(greatest(width, height) AS DOUBLE), 9) AS scale FROM img"))
def _(spark, d):
    return X.images(spark, d).select("width", "height", F.round(inference.resize_scale(F.col("width"), F.col("height")), 9).alias("scale")).distinct()


# Splits


@query("grouped_ratios", sql("""
, f AS (SELECT image_id, fold AS g, min(image_id) OVER (PARTITION BY fold) AS first, unnest(range(5)) AS split_fold FROM img),
r AS (SELECT *, row_number() OVER (PARTITION BY split_fold ORDER BY ((first + split_fold * 7919 + 42) * 2654435761) % 4294967296, first, image_id) - 1 AS pos, count(*) OVER (PARTITION BY split_fold) AS n FROM f),
s AS (SELECT *, greatest(1, CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT)) AS n_test, greatest(1, CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT)) AS n_val FROM r)
SELECT image_id, CAST(split_fold AS INT) AS split_fold, CASE WHEN pos < n_test THEN 'test' WHEN pos < n_test + n_val THEN 'val' ELSE 'train' END AS split FROM s"""))
def _(spark, d):
    return splits.grouped_ratios(X.images(spark, d), "fold").select("image_id", "split_fold", "split")


@query("padded_stems", sql("SELECT file_name, CASE WHEN length(s) >= 12 THEN s ELSE lpad(s, 12, '0') END AS padded FROM (SELECT file_name, regexp_replace(file_name, '\\.[^.]*$', '') AS s FROM img)"))
def _(spark, d):
    return splits.by_padded_stem(X.images(spark, d)).select("file_name", splits.padded_stem().alias("padded"))


@query("unfinished_folds", sql("SELECT DISTINCT fold FROM img WHERE fold NOT IN (1, 3)"))
def _(spark, d):
    own = X.images(spark, d).select("fold").distinct()
    return splits.unfinished(own, X.images(spark, d).filter("fold IN (1, 3)").select("fold"))


@query("random_image", sql("SELECT 1 AS picked, TRUE AS known"))
def _(spark, d):
    own = splits.random_image(X.images(spark, d), 7).select("image_id").join(X.images(spark, d).select("image_id", F.lit(True).alias("known")), "image_id", "left")
    return own.agg(F.count(F.lit(1)).cast("int").alias("picked"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known"))


@query("repeated_stems", sql("SELECT 'img_' || image_id AS stem, 2 AS n_images FROM img WHERE image_id % 7 = 0"))
def _(spark, d):
    own = X.images(spark, d).select("file_name")
    again = own.filter("CAST(regexp_extract(file_name, '[0-9]+', 0) AS INT) % 7 = 0").select(F.regexp_replace("file_name", "jpg$", "png").alias("file_name"))
    return cleaning.repeated_stems(own.unionByName(again)).select("stem", F.col("n_images").cast("int").alias("n_images"))


# Result tables


@query("fold_numbers", sql("SELECT DISTINCT CAST(fold AS INT) AS fold FROM img"))
def _(spark, d):
    return stats.fold_numbers(X.images(spark, d).select(F.concat(F.lit("fold_"), F.col("fold").cast("string")).alias("fold")).distinct())


@query("named_models", sql("SELECT image_id, CASE image_id % 3 WHEN 0 THEN 'First' WHEN 1 THEN 'Second' END AS display FROM img"))
def _(spark, d):
    names = spark.createDataFrame([("m0", "First"), ("m1", "Second"), ("m9", "Unused")], "model string, display string")
    return stats.named(X.images(spark, d).select("image_id", F.concat(F.lit("m"), (F.col("image_id") % 3).cast("string")).alias("model")), names).select("image_id", "display")


def _display_queries(suffix: str, steps: list[float]) -> None:
    @query(f"displayed_summary{suffix}", sql(sweep_sql(steps) + ", o AS (SELECT threshold, round(avg(fscore), 5) AS fscore_mean, round(coalesce(stddev_samp(fscore), 0), 5) AS fscore_std FROM fm WHERE threshold < 0.5 OR fold = 0 GROUP BY threshold) SELECT * FROM o"))
    def _(spark, d):
        own = _fold_metrics(spark, d, steps).filter("threshold < 0.5 OR fold = 0")
        return rounded(sweep.displayed(own, ("threshold",)).select("threshold", "fscore_mean", "fscore_std"), "fscore_mean", "fscore_std", digits=5)

    @query(f"suggested_threshold{suffix}", sql(sweep_sql(steps) + " SELECT threshold, round(fscore, 5) AS fscore, 'asahi_rect' AS mode FROM cv ORDER BY cv.fscore DESC, threshold LIMIT 1"))
    def _(spark, d):
        own = sweep.curve(_fold_metrics(spark, d, steps))
        both = own.withColumn("mode", F.lit("asahi_rect")).unionByName(own.withColumns({"mode": F.lit("sahi"), "fscore": F.col("fscore") * 2}))
        return rounded(sweep.suggested(both, ["sahi", "asahi_rect"]).select("threshold", "fscore", "mode"), "fscore", digits=5)


#: As for the sweeps: four steps, and the reference's.
_display_queries("", STEPS)
_display_queries("_full", sweep.VALIDATION)


def _cube_rows(suffix: str, steps: list[float]) -> None:
    at = {"map50": 4, "precision": 4, "recall": 4, "fscore": 4, "mae": 3}

    @query(f"threshold_cube_rows{suffix}", sql(sweep_sql(steps) + f" SELECT printf('%.2f', threshold) AS threshold, CAST(fold AS VARCHAR) AS fold, {', '.join(f'CAST(round(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38, 18)), {n}) AS DOUBLE) AS {c}' for c, n in at.items())} FROM fm"))
    def _(spark, d):
        """The dashboard's document, read again."""
        own = sweep.cube(_fold_metrics(spark, d, steps).withColumn("arch", F.lit("made")), ("arch",))
        rows = own.select(F.explode(F.from_json("metrics", "map<string,map<string,array<double>>>")).alias("threshold", "folds"))
        rows = rows.select("threshold", F.explode("folds").alias("fold", "v"))
        return rows.select("threshold", "fold", *[F.round(F.col("v")[i], n).alias(c) for i, (c, n) in enumerate(at.items())])


_cube_rows("", STEPS)
_cube_rows("_full", sweep.CUBE)


# Similarity, suppression, engines

def clamped_sql(a: str, b: str) -> str:
    dist = "+".join(f"(({a}.{c}1 + {a}.{c}2) / 2 - ({b}.{c}1 + {b}.{c}2) / 2) * (({a}.{c}1 + {a}.{c}2) / 2 - ({b}.{c}1 + {b}.{c}2) / 2)" for c in "xy")
    diag = "+".join(f"(greatest({a}.{c}2, {b}.{c}2) - least({a}.{c}1, {b}.{c}1)) * (greatest({a}.{c}2, {b}.{c}2) - least({a}.{c}1, {b}.{c}1))" for c in "xy")
    return f"({iou_of(a, b)} - ({dist}) / greatest({diag}, 1e-6))"


@query("similarities", sql(f""", n AS (SELECT det_id, x1, y1, x2, y2, lead(struct_pack(det_id := det_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2)) OVER (PARTITION BY image_id, label ORDER BY score DESC, det_id) AS b FROM det)
SELECT n.det_id AS a, b.det_id AS b, round({iou_of('n', 'b')}, 6) AS iou, round({diou_of('n', 'b')}, 6) AS diou, round({clamped_sql('n', 'b')}, 6) AS clamped FROM n WHERE b IS NOT NULL"""))
def _(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("image_id", "label").orderBy(F.desc("score"), "det_id")
    own = X.detections(spark, d).withColumn("other", F.lead(F.struct("det_id", *G.EDGES)).over(w)).filter("other IS NOT NULL")
    a, b = G.corners(), G.fields(F.col("other"))
    return own.select(F.col("det_id").alias("a"), F.col("other.det_id").alias("b"), *[F.round(f(a, b), 6).alias(n) for n, f in (("iou", G.iou), ("diou", G.diou), ("clamped", G.clamped_diou))])


_ALIKE = clamped_sql("rest[1]", "q")


@query("adaptive_kept", sql(f""", grp AS (SELECT image_id, label, list(struct_pack(d := det_id, s := score, x1 := x1, y1 := y1, x2 := x2, y2 := y2) ORDER BY score DESC, det_id) AS l FROM det GROUP BY ALL),
ad AS (SELECT image_id, label, l AS rest, CAST([] AS BIGINT[]) AS kept FROM grp
  UNION ALL SELECT image_id, label, list_filter(rest[2:], lambda q: NOT ({_ALIKE} > cut OR ({_ALIKE} > 0.7 AND q.s >= 0.5::DOUBLE * rest[1].s))), list_append(kept, rest[1].d)
  FROM (SELECT *, greatest(0.3::DOUBLE, 0.5::DOUBLE - 0.1::DOUBLE * list_avg(list_sort(list_transform(rest[2:], lambda q: {_ALIKE}), 'DESC')[1:5])) AS cut FROM ad WHERE len(rest) > 0))
SELECT unnest(kept) AS det_id FROM ad WHERE len(rest) = 0"""))
def _(spark, d):
    return suppression.adaptive_nms(X.detections(spark, d)).select("det_id")


_FUSED = iou_of("l[i + 1]", "q")


@query("fused_boxes", sql(f""", prep AS (SELECT image_id, label, det_id, score, {', '.join(f'greatest(0.0::DOUBLE, least(1.0::DOUBLE, {e})) AS {e}' for e in ('x1', 'y1', 'x2', 'y2'))} FROM det WHERE score >= 0.001),
grp AS (SELECT image_id, label, list(struct_pack(d := det_id, s := score, x1 := x1, y1 := y1, x2 := x2, y2 := y2) ORDER BY score DESC, det_id) AS l FROM prep WHERE (x2 - x1) * (y2 - y1) > 0 GROUP BY ALL),
wb AS (SELECT image_id, label, l, 1 AS i, [struct_pack(d := l[1].d, n := 1, w := l[1].s, x1 := l[1].x1, y1 := l[1].y1, x2 := l[1].x2, y2 := l[1].y2, a := l[1].s * l[1].x1, b := l[1].s * l[1].y1, c := l[1].s * l[1].x2, e := l[1].s * l[1].y2)] AS f FROM grp
  UNION ALL SELECT image_id, label, l, i + 1, CASE WHEN list_max(o) > 0.45 THEN list_transform(f, lambda q, k: CASE WHEN k = list_position(o, list_max(o)) THEN
      struct_pack(d := q.d, n := q.n + 1, w := q.w + l[i + 1].s, x1 := (q.a + l[i + 1].s * l[i + 1].x1) / (q.w + l[i + 1].s), y1 := (q.b + l[i + 1].s * l[i + 1].y1) / (q.w + l[i + 1].s), x2 := (q.c + l[i + 1].s * l[i + 1].x2) / (q.w + l[i + 1].s), y2 := (q.e + l[i + 1].s * l[i + 1].y2) / (q.w + l[i + 1].s),
        a := q.a + l[i + 1].s * l[i + 1].x1, b := q.b + l[i + 1].s * l[i + 1].y1, c := q.c + l[i + 1].s * l[i + 1].x2, e := q.e + l[i + 1].s * l[i + 1].y2) ELSE q END)
    ELSE list_append(f, struct_pack(d := l[i + 1].d, n := 1, w := l[i + 1].s, x1 := l[i + 1].x1, y1 := l[i + 1].y1, x2 := l[i + 1].x2, y2 := l[i + 1].y2, a := l[i + 1].s * l[i + 1].x1, b := l[i + 1].s * l[i + 1].y1, c := l[i + 1].s * l[i + 1].x2, e := l[i + 1].s * l[i + 1].y2)) END
  FROM (SELECT *, list_transform(f, lambda q: {_FUSED}) AS o FROM wb WHERE i < len(l)))
SELECT image_id, label, q.d AS det_id, round(q.w / q.n, 9) AS score, round(q.x1, 9) AS x1, round(q.y1, 9) AS y1, round(q.x2, 9) AS x2, round(q.y2, 9) AS y2 FROM (SELECT image_id, label, unnest(f) AS q FROM wb WHERE i = len(l))"""))
def _(spark, d):
    return rounded(suppression.wbf(X.detections(spark, d)).select("image_id", "label", "det_id", "score", "x1", "y1", "x2", "y2"), "score", "x1", "y1", "x2", "y2", digits=9)


@query("engine_detections", sql(tile_sql("sahi") + """, t AS (SELECT image_id, width, height, x, y, tile_width, tile_height FROM tl UNION ALL SELECT image_id, width, height, 0, 0, width, height FROM img),
q AS (SELECT *, ((x + y + image_id) % 90 + 5) / 100.0::DOUBLE AS score FROM t), r AS (SELECT image_id, score, x, y, (x + 10) / CAST(width AS DOUBLE) AS x1, (y + 10) / CAST(height AS DOUBLE) AS y1, least(1, (x + 60) / CAST(width AS DOUBLE)) AS x2, least(1, (y + 700) / CAST(height AS DOUBLE)) AS y2 FROM q WHERE score >= 0.1)
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, y, x, x1, y1, x2, y2) AS det_id, round(score, 6) AS score, round(x1, 6) AS x1, round(y2, 6) AS y2 FROM r"""))
def _(spark, d):
    """An engine that finds one box in each tile."""

    def engine(frames):
        for pdf in frames:
            score = ((pdf["x"] + pdf["y"] + pdf["image_id"]) % 90 + 5) / 100.0
            yield pdf[["image_id"]].assign(tile_x=pdf["x"], tile_y=pdf["y"], label=0, score=score, x1=10.0, y1=10.0, x2=60.0, y2=700.0)

    own = X.images(spark, d).select("image_id", "width", "height")
    return rounded(inference.collected(own, tiling.tiles(own, TILINGS["sahi"]), engine).select("image_id", "det_id", "score", "x1", "y2"), "score", "x1", "y2")


# Failures


def _failing():
    """An engine as in engine_detections that raises at the second column of every 17th image."""

    import numpy as np
    import pandas as pd

    def predict(pdf):
        image = pdf["image_id"].to_numpy()
        bad = np.flatnonzero((image % 17 == 0) & (pdf["column_index"].to_numpy() == 1))
        if len(bad):
            raise ValueError("tile {row_index}-{column_index} of image {image_id}".format(**pdf.iloc[bad[0]]))
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        return pd.DataFrame({"image_id": image, "tile_x": x, "tile_y": y, "label": 0, "score": ((x + y + image) % 90 + 5) / 100.0, "x1": 10.0, "y1": 10.0, "x2": 60.0, "y2": 600.0})

    return predict


def _captured(spark, d):
    own = X.images(spark, d).select("image_id", "width", "height")
    return inference.infer_captured(own, tiling.tiles(own, TILINGS["sahi"]), _failing, method="nms", conf=0.1)


@query("captured_detections", sql(tile_sql("sahi") + """, q AS (SELECT *, ((x + y + image_id) % 90 + 5) / 100.0::DOUBLE AS score FROM tl WHERE image_id % 17 <> 0),
r AS (SELECT image_id, score, x, y, (x + 10) / CAST(width AS DOUBLE) AS x1, (y + 10) / CAST(height AS DOUBLE) AS y1, least(1, (x + 60) / CAST(width AS DOUBLE)) AS x2, least(1, (y + 600) / CAST(height AS DOUBLE)) AS y2 FROM q WHERE score >= 0.1)
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, y, x, x1, y1, x2, y2) AS det_id, round(score, 6) AS score, round(x1, 6) AS x1, round(y2, 6) AS y2 FROM r"""))
def _(spark, d):
    return rounded(_captured(spark, d)[0].select("image_id", "det_id", "score", "x1", "y2"), "score", "x1", "y2")


@query("captured_failures", sql("SELECT image_id, 'ValueError: tile 0-1 of image ' || image_id AS error FROM img WHERE image_id % 17 = 0"))
def _(spark, d):
    return _captured(spark, d)[2].failures


@query("captured_summary", sql(tile_sql("sahi") + """, q AS (SELECT image_id, count(*) FILTER (((x + y + image_id) % 90 + 5) / 100.0::DOUBLE >= 0.1) AS raw_count FROM tl WHERE image_id % 17 <> 0 GROUP BY ALL)
SELECT image_id, raw_count, (SELECT count(*) FROM img WHERE image_id % 17 <> 0) AS processed, (SELECT count(*) FROM img WHERE image_id % 17 = 0) AS failed FROM q"""))
def _(spark, d):
    raw, final, outcome = _captured(spark, d)
    own = inference.summary(outcome.done, raw, final).select("image_id", "raw_count")
    return own.select("*", F.lit(outcome.counts["done"]).alias("processed"), F.lit(outcome.counts["failed"]).alias("failed"))

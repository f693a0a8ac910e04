import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import config, service
from gridloom.operators import cleaning, inference, labels, reconstruct, reports, splits, stats, tiling, validation
from gridloom.sources import readers, writers

IMAGES = [(1, "a.jpg", 100, 80), (2, "b.PNG", None, None), (3, "c.jpg", 50, 50), (4, "gone.jpg", 10, 10)]
ANN = [(1, 1, 1, [10.0, 10.0, 20.0, 20.0], 400.0), (2, 1, 1, [-5.0, 0.0, 20.0, 20.0], None), (3, 9, 1, [0.0, 0.0, 1.0, 1.0], 1.0), (4, 1, 7, [0.0, 0.0, 1.0, 1.0], 1.0), (5, 1, 1, [0.0, 0.0, 1.0], 1.0), (6, 1, 1, [200.0, 0.0, 5.0, 5.0], 25.0), (7, 2, 1, [0.0, 0.0, 500.0, 5.0], 2500.5), (8, 9, 7, [0.0], None)]


@pytest.fixture
def coco(spark):
    return (spark.createDataFrame(IMAGES, "id long, file_name string, width int, height int"), spark.createDataFrame(ANN, "id long, image_id long, category_id long, bbox array<double>, area double"), spark.createDataFrame([(1, "x")], "id long, name string"))


def test_reasons_in_order(coco):
    got = {r.id: r for r in cleaning.examined(*coco).collect()}
    assert {i: r.reason for i, r in got.items()} == {1: None, 2: None, 3: "unknown_image", 4: "unknown_category", 5: "malformed_bbox", 6: "degenerate_bbox", 7: None, 8: "unknown_image"}
    assert {i for i, r in got.items() if r.clamped} == {2, 6} and {i for i, r in got.items() if r.area_fixed} == {2}
    assert (got[2].x, got[2].w, got[2].area, got[7].w, got[7].area) == (0, 15, 300, 500, 2500.5)
    report = cleaning.report(cleaning.examined(*coco)).first()
    assert (report.total, report.kept, report.clamped) == (8, 3, 2)
    assert cleaning.cleaned(coco[0], coco[1], coco[2].limit(0)).filter("id = 4").count() == 1  # without categories none is unknown


def test_files(spark, coco):
    files = spark.createDataFrame([("a.jpg",), ("b.PNG",), ("c.jpg",), ("stray.jpg",)], "file_name string")
    assert [r.file_name for r in cleaning.missing(coco[0], files).collect()] == ["gone.jpg"]
    assert [r.file_name for r in cleaning.orphans(coco[0], files).collect()] == ["stray.jpg"]
    found = {(r.rule, r.subject) for r in validation.findings(*coco, files).collect()}
    assert {("missing_file", "gone.jpg"), ("orphan_file", "stray.jpg"), ("no_dimensions", "2"), ("unknown_image", "3"), ("unknown_category", "4"), ("malformed_bbox", "5"), ("negative_origin", "2"), ("out_of_bounds", "6")} <= found
    assert service.validate_dataset(*coco, files)[0].first().status == "errors"
    assert {r.id: r.status for r in service.clean_dataset(coco[0], coco[1], files).collect()} == {1: "kept", 2: "kept", 3: "no_annotation", 4: "no_file"}
    assert cleaning.repeated_stems(spark.createDataFrame([("a.jpg",), ("a.png",)], "file_name string")).first().stem == "a"


@pytest.mark.parametrize("n,sizes", [(100, {(68, 12, 20)}), (23, {(15, 3, 5), (16, 3, 4)})])
def test_split_sizes(spark, n, sizes):
    own = splits.kfold_holdout(spark.range(n).withColumnRenamed("id", "image_id"))
    got = own.groupBy("split_fold").pivot("split").count().collect()
    assert {(r.train, r.val, r.test) for r in got} == sizes
    assert own.filter("split = 'test'").select("image_id").distinct().count() == n
    compatible = splits.compatible_kfold(list(range(n)), 5, 0.15, 42)
    assert {(len(f["train"]), len(f["val"]), len(f["test"])) for f in compatible} == sizes
    assert sorted(i for f in compatible for i in f["test"]) == list(range(n))


def test_other_splits(spark):
    own = splits.compatible_ratios(list("abcdefghij"), 3, 0.2, 0.2, 7, {"a": "g", "b": "g"})
    assert all(sorted(f["train"] + f["val"] + f["test"]) == list("abcdefghij") for f in own)
    with pytest.raises(ValueError):
        splits.sizes_fit(2, 0.5, 0.5)
    assert splits.group_folds({"a": 5, "b": 3, "c": 3, "d": 2}, 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    names = spark.createDataFrame([("10.jpg",), ("9.jpg",), ("a_very_long_name.jpg",)], "file_name string")
    assert [r.file_name for r in splits.by_padded_stem(names).collect()] == ["9.jpg", "10.jpg", "a_very_long_name.jpg"]
    assert splits.sample_empty(spark.range(50).withColumnRenamed("id", "tile_id"), 30, 0.1, "tile_id").count() == 3


def test_labels(spark):
    ann = spark.createDataFrame([(1, 1, 1, 16, 8, 8, 8, 64, 32)], "ann_id long, image_id long, category_id long, x int, y int, w int, h int, width int, height int")
    row = labels.full_image_labels(ann).first()
    assert (row.cx, row.cy, row.bw, row.bh) == (200 / 640, (120 + 160) / 640, 80 / 640, 80 / 640)
    assert labels.holdout_labels(ann).first().cx == 20 / 64
    tiled = tiling.tiles(spark.createDataFrame([(1, 64, 32)], "image_id long, width int, height int"), tiling.Tiling("sahi", 0.25, (16, 16)))
    kept = labels.tile_boxes(ann, tiled, 0.2)
    assert {(r.tile_x, round(r.ioa, 6)) for r in kept.filter("tile_y = 0 OR tile_y = 12").collect()} >= {(12, 0.25)} or kept.count() > 0
    lines = labels.label_lines(labels.tile_labels(kept).withColumn("cls", F.lit(0)), ("image_id", "tile_x", "tile_y"), "ann_id").collect()
    assert all(len(x.text.split()) == 5 for x in lines)
    names = spark.createDataFrame([("img_7_tile_0_544.jpg",), ("img_7_fi.jpg",), ("x_tile_a.jpg",)], "n string")
    assert [r.s for r in names.select(labels.original_stem(F.col("n")).alias("s")).collect()] == ["img_7", "img_7", "x_tile_a"]


def test_label_round_trip(spark, tmp_path):
    images = spark.createDataFrame([("a.jpg", 200, 100), ("b.jpg", 50, 50), ("c.jpg", None, None)], "file_name string, width int, height int")
    lines = spark.createDataFrame([("a.txt", "0 .5 .5 .4 .4\nbad 1\n9 0.1 0.1 0.4 0.1 more"), ("b.txt", "")], "sample_name string, text string")
    parsed = readers.parsed_labels(lines)
    corners = labels.corners_of(parsed).orderBy("line_no").collect()
    assert len(corners) == 2 and abs(corners[0].x1 - 0.3) < 1e-12 and abs(corners[0].y2 - 0.7) < 1e-12
    own = parsed.withColumn("file_name", F.regexp_replace("sample_name", "txt$", "jpg"))
    numbered, ann = labels.to_coco(own, images, 2)
    assert {r.file_name: r.id for r in numbered.collect()} == {"a.jpg": 1, "b.jpg": 2, "c.jpg": 3}
    got = sorted(ann.collect(), key=lambda r: r.id)
    assert [(r.id, r.category_id, round(r.x), round(r.bw)) for r in got] == [(1, 1, 60, 80), (2, 9, 0, 80)]


def test_decode_and_reproject(spark):
    rows = spark.createDataFrame([(1, [2.0, 0.0, 0.0]), (2, [0.0, 0.0, 9.0]), (3, [0.0, 1.0, 1.0])], "q long, logits array<double>")
    got = {r.q: r for r in inference.decode_queries(rows, 0.4).collect()}
    e = np.exp([2.0, 0, 0])
    assert set(got) == {1, 3} and got[1].label == 0 and abs(got[1].score - e[0] / e.sum()) < 1e-12 and got[3].label == 1
    det = spark.createDataFrame([(1, 100, 100, 200, 200, 0.0, 0.0, 50.0, 300.0), (1, 100, 100, 200, 200, 500.0, 0.0, 600.0, 10.0)], "image_id long, tile_x int, tile_y int, width int, height int, x1 double, y1 double, x2 double, y2 double")
    (r,) = inference.reproject(det).collect()
    assert (r.x1, r.y1, r.x2, r.y2) == (0.5, 0.5, 0.75, 1.0)


def test_pipeline_with_a_fake_engine(spark):
    images = spark.createDataFrame([(1, 1000, 700), (2, 640, 640)], "image_id long, width int, height int")

    def engine(frames):
        for f in frames:
            yield f.assign(tile_x=f.x, tile_y=f.y, label=0, score=0.8, x1=1.0, y1=1.0, x2=30.0, y2=30.0)[["image_id", "tile_x", "tile_y", "label", "score", "x1", "y1", "x2", "y2"]]

    final, summary = service.infer_dataset(images, tiling.Tiling("sahi"), engine, method="nms")
    got = {r.image_id: r for r in summary.collect()}
    assert final.count() == 5 and got[1].raw_count == 4 and got[2].final_count == 1 and got[2].score_mean == 0.8
    assert inference.with_full_image("asahi") and not inference.with_full_image("sahi") and inference.engine_of("yolov8n") == "yolo"
    with pytest.raises(ValueError):
        inference.engine_of("other")


def test_rebuild(spark):
    r = np.random.default_rng(0)
    image = r.integers(0, 255, (30, 40, 3)).astype(np.uint8)
    one = spark.createDataFrame([(1, 40, 30)], "image_id long, width int, height int")
    tiled = tiling.tiles(one, tiling.Tiling("sahi", 0.25, (16, 16))).toPandas()
    tiled["pixels"] = [image[t.y : t.y + t.tile_height, t.x : t.x + t.tile_width].tobytes() for t in tiled.itertuples()]
    tiles = spark.createDataFrame(tiled)
    for size in (1, 120, 500, 1 << 20):  # strips of one row, of a few, and the whole image
        assert bytes(reconstruct.rebuild(tiles, size).first().pixels) == image.tobytes()
    assert reconstruct.strips(tiles, 500).count() == 8 and reconstruct.rebuild(tiles.limit(0)).collect() == []
    # Overlaps are means, cut; what no tile covers is 0, also a whole strip; what lies beyond the image goes.
    odd = spark.createDataFrame([(7, 2, 4, 0, 0, 2, 1, bytes([1] * 6)), (7, 2, 4, 1, 0, 2, 1, bytes([4] * 6)), (7, 2, 4, 0, 3, 2, 2, bytes([9] * 12)), (7, 2, 4, 5, 9, 1, 1, bytes(3))], "image_id long, width int, height int, x int, y int, tile_width int, tile_height int, pixels binary")
    for size in (1, 12, 100):
        assert list(reconstruct.rebuild(odd, size).first().pixels) == [1, 1, 1, 2, 2, 2] + [0] * 12 + [9] * 6
    originals = spark.createDataFrame([(1, image.tobytes()), (2, b"x")], "image_id long, pixels binary")
    assert [x.image_id for x in service.validate_rebuilt(originals, tiles).collect()] == [2]


def test_sources_and_sinks(spark, coco, tmp_path):
    folder = f"{tmp_path}/data"
    (tmp_path / "data").mkdir()
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 4, "height": 3, "extra": "kept"}], "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "bbox": [0, 0, 1, 1]}], "categories": [{"id": 2, "name": "x"}]}
    (tmp_path / "data" / readers.RAW).write_text(json.dumps(doc))
    own = readers.coco(spark, folder)
    assert own["images"].first().width == 4 and own["annotations"].first().area is None
    assert "kept" in readers.coco_raw(spark, f"{folder}/{readers.RAW}", "images").first().entry
    writers.write_coco(f"{tmp_path}/clean", own["images"], own["annotations"], own["categories"])
    text = next((tmp_path / "clean").glob("part-*")).read_text()
    assert json.loads(text)["categories"] == [{"id": 2, "name": "x"}]
    (tmp_path / "data" / readers.CLEAN).write_text(text)
    assert readers.annotation_path(spark, folder).endswith(readers.CLEAN)
    with pytest.raises(FileNotFoundError):
        readers.coco(spark, f"{tmp_path}/nowhere")
    (tmp_path / "data" / "z.JPG").write_bytes(b"123")
    (tmp_path / "data" / "note.txt").write_text("0 .5 .5 .1 .1")
    assert [(r.file_name, r.bytes) for r in readers.image_listing(spark, folder).collect()] == [("z.JPG", 3)]
    assert readers.parsed_labels(readers.label_lines(spark, folder)).first().sample_name == "note.txt"
    rows = spark.createDataFrame([("m", 1)], "models string, fold int")
    for _ in range(2):
        writers.append_csv(rows, f"{tmp_path}/res", ["models", "fold"])
    assert readers.results(spark, f"{tmp_path}/res", "models string, fold int").count() == 2
    writers.append_csv(rows, f"{tmp_path}/res", ["fold"])
    assert readers.results(spark, f"{tmp_path}/res").columns == ["fold"]
    writers.write_folds(spark.createDataFrame([(1, 1), (2, 2)], "v int, fold int"), f"{tmp_path}/folds")
    writers.write_folds(spark.createDataFrame([(9, 2)], "v int, fold int"), f"{tmp_path}/folds")
    assert {(r.v, r.fold) for r in spark.read.parquet(f"{tmp_path}/folds").collect()} == {(1, 1), (9, 2)}
    assert writers.export_labels(f"{tmp_path}/txt", spark.createDataFrame([("s", "0 1 1 1 1"), ("t", None)], "sample_name string, text string")) == 2
    assert (tmp_path / "txt" / "t.txt").read_text() == ""
    assert readers.next_id(spark, f"{tmp_path}/none") == 1
    for n in (10, 2):
        writers.write_fold_yaml(spark, f"{tmp_path}/y/fold_{n}.yaml", "/d", ["x"])
    assert [p.rsplit("/", 1)[1] for p in readers.folds(spark, f"{tmp_path}/empty", f"{tmp_path}/y")] == ["fold_2.yaml", "fold_10.yaml"]
    writers.write_json(spark, f"{tmp_path}/m/ds/fold_1/detr/manifest.json", {"checkpoint": "w.pt"})
    writers.write_text(spark, f"{tmp_path}/m/ds/fold_1/detr/w.pt", "x")
    assert readers.checkpoint(spark, f"{tmp_path}/m", "ds", 1, "DETR").endswith("detr/w.pt")
    writers.write_json(spark, f"{tmp_path}/stats.json", {"train_metrics": [{"image_name": "a", "slicing_time_ms": 2.0}], "val_metrics": [], "test_metrics": [{"image_name": "b", "slicing_time_ms": 4.0}]})
    assert {r.split for r in readers.fold_stats(spark, f"{tmp_path}/old.json", f"{tmp_path}/stats.json").collect()} == {"train", "test"}
    assert readers.config_overlap({"overlap_x": 96, "tile_size": [640, 640]}) == 0.15
    det = spark.createDataFrame([("val", "a", "d", 1, "i", 1, 0, 0.5, 0.0, 0.0, 1.0, 1.0)], readers.DETECTION)
    made = readers.cached(spark, f"{tmp_path}/det", lambda: det)
    assert made.count() == 1 and readers.cached(spark, f"{tmp_path}/det", None).count() == 1


def test_statistics(spark):
    rows = spark.createDataFrame([(m, float(v)) for m, vs in (("a", (1, 2, 3)), ("b", (2, 3, 4)), ("c", (9, 10, 11))) for v in vs], "model string, value double")
    a = stats.anova(rows.withColumn("metric", F.lit("m"))).first()
    assert abs(a.f - 57.0) < 1e-9 and (a.df_between, a.df_within) == (2, 6)
    pairs = {(p["a"], p["b"]): p["p"] for p in stats.tukey(rows, keys=()).collect()}
    assert pairs["a", "b"] > 0.05 > pairs["a", "c"]
    assert stats.letters({"a": 2, "b": 3, "c": 10}, {("a", "c"), ("b", "c")}) == {"c": "a", "b": "b", "a": "b"}
    assert stats.linear_fit(spark.createDataFrame([(1, 3), (2, 5)], "groundtruth long, predicted long")).first().slope == 2
    assert stats.linear_fit(spark.createDataFrame([(1, 3), (1, 5)], "groundtruth long, predicted long")).first().slope is None
    constant = stats.anova(rows.withColumns({"metric": F.lit("m"), "value": F.lit(1.0)})).first()
    assert constant.f is None
    assert stats.fold_numbers(spark.createDataFrame([("fold_3",)], "fold string")).first().fold == 3


def test_reports(spark):
    m = spark.createDataFrame([("a", 0, "test", 5, 1.0), ("a", 1, "train", 6, 3.0), ("b", 0, "train", 7, 5.0)], "image_name string, fold int, split string, tiles_generated int, slicing_time_ms double")
    m = m.withColumns({c: F.lit(2) for c in ("annotations_original", "annotations_discarded", "empty_tiles_kept", "empty_tiles_discarded")})
    r = reports.run_summary(m).first()
    assert (r.original_images, r.tiles_all_folds, r.mean_tiles_per_image, r.discard_rate_pct, r.std_time_ms) == (2, 18, 9.0, 100.0, 2.0)
    assert reports.run_summary(m.withColumn("annotations_original", F.lit(0))).first().discard_rate_pct == 0.0


def test_config():
    block = {"dataset": {"input_path": "./i", "output_path": "./dataset/sahi"}, "slicing": {"mode": "sahi", "tile_size": [640, 640], "overlap_ratio": 0.15}, "models": ["YOLOV8N"]}
    (one,) = config.setups({"setups": [{"name": "s", "config": "f"}]}, lambda _: block)
    assert one.name == "sahi" and config.result_label(one.name, "YOLOV8N") == "SAHI_YOLOV8N"
    assert config.setups({"processes": [block]}, None)[0].index == 1
    for part, key, bad in (("slicing", "mode", "x"), ("slicing", "overlap_ratio", 1.5), ("crossfolds", "n_folds", 1), ("crossfolds", "ioa_threshold", 0), ("inference", "suppression", "x"), ("inference", "batch_size", 0)):
        with pytest.raises(ValueError):
            config.setup({**block, part: {**block.get(part, {}), key: bad}}, 1)
    with pytest.raises(ValueError):
        config.setups({"setups": [{"name": "s", "config": "f"}], "setups_to_run": ["t"]}, lambda _: block)
    with pytest.raises(ValueError):
        config.setups({}, None)
    assert config.chosen(["A", "B"], config.wanted(["b, a"])) == ["B", "A"] and config.chosen(["A"], None) == ["A"]
    assert [config.canonical_model(m) for m in ("detr", "fasterrcnn", "yolov8n", "Own")] == ["DETR", "Faster", "YOLOV8N", "Own"]
    with pytest.raises(ValueError):
        config.canonical_model("yolo")


def test_requests(spark):
    images = spark.createDataFrame([(1, "a.jpg", 700, 700), (2, "b.jpg", 100, 100)], "image_id long, file_name string, width int, height int")
    assert service.slice_image(images, 1, tiling.Tiling()).count() == 4
    with pytest.raises(ValueError):
        service.slice_image(images, 2, tiling.Tiling())
    assert {r.image_id: r.n_tiles for r in service.slice_dataset(images, tiling.Tiling())[1].collect()} == {1: 4, 2: 1}


def test_stream(spark, tmp_path):
    from gridloom.streaming import detections as D
    from tests.test_suppression import SCHEMA

    rows = [(1, 0, 0, 0.9, 0.0, 0.0, 1.0, 1.0), (1, 1, 0, 0.8, 0.0, 0.0, 1.0, 1.0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = D.suppressed(D.stream(spark, f"{tmp_path}/in", SCHEMA), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination()
    assert [r.det_id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [0]


def test_pixels_and_weights(spark, tmp_path):
    from gridloom.sources import pixels

    image = np.arange(20 * 30 * 3, dtype=np.uint8).reshape(20, 30, 3)
    one = spark.createDataFrame([(1, 30, 20, image.tobytes())], "image_id long, width int, height int, pixels binary")
    tiled = tiling.tiles(one.select("image_id", "width", "height"), tiling.Tiling("sahi", 0.25, (16, 16)))
    cut = pixels.cropped(one, tiled)
    assert bytes(reconstruct.rebuild(cut).first().pixels) == image.tobytes()
    assert {len(r.file) for r in pixels.encoded(cut, lambda a: a[:2].tobytes()).collect()} == {2 * 16 * 3}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jpg").write_bytes(b"1")
    assert pixels.copy_files(spark, f"{tmp_path}/a", f"{tmp_path}/b", ["x.jpg", "none.jpg"]) == 1
    for model in ("YOLOV8N", "other"):
        writers.write_text(spark, f"{tmp_path}/w/sahi/model_checkpoints/fold_1/{model}/best.pt", "x")
    (path,) = writers.weight_manifests(spark, f"{tmp_path}/w", f"{tmp_path}/models", "sahi", 2, inference.engine_of)
    assert readers.checkpoint(spark, f"{tmp_path}/models", "sahi", 1, "YOLOV8N").endswith("best.pt") and path.endswith("YOLOV8N/manifest.json")

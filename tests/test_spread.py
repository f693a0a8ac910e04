from gridloom.operators import failures, inference, reconstruct, tiling
from gridloom.sources import pixels, readers, writers
from gridloom.sources.scratch import spread


def test_tiles_of_one_file_of_images_are_dealt(spark, monkeypatch):
    seen, real = [], failures.captured
    monkeypatch.setattr(failures, "captured", lambda rows, *more: seen.append(rows.rdd.getNumPartitions()) or real(rows, *more))
    images = spark.createDataFrame([(i, 1300, 700) for i in range(6)], "image_id long, width int, height int").coalesce(1)
    load = lambda: lambda pdf: pdf[["image_id"]].assign(tile_x=pdf["x"], tile_y=pdf["y"], label=0, score=0.9, x1=1.0, y1=1.0, x2=50.0, y2=50.0)
    raw, _, outcome = inference.infer_captured(images, tiling.tiles(images, tiling.Tiling("sahi")), load, method="nms")
    assert seen == [spread(spark)] and outcome.counts["done"] == 6 and raw.count() == tiling.tiles(images, tiling.Tiling("sahi")).count()


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"{i}.txt").write_text(f"{i}")
    (tmp_path / "other.csv").write_text("x")
    rows = readers.label_lines(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() <= spread(spark)
    assert sorted((r.sample_name, r.text) for r in rows.collect()) == sorted((f"{i}.txt", f"{i}") for i in range(200)) or sorted(r.text for r in rows.collect()) == sorted(map(str, range(200)))
    assert pixels.load(spark, str(tmp_path)).rdd.getNumPartitions() <= spread(spark)


def test_copies_list_nothing(spark, tmp_path, monkeypatch):
    for n in ("a.jpg", "b.jpg", "_hidden.jpg"):
        (tmp_path / n).write_bytes(n.encode())
    names = spark.createDataFrame([("a.jpg",), ("a.jpg",), ("none.jpg",), ("_hidden.jpg",), (None,)], "file_name string")
    monkeypatch.setattr(type(spark), "read", property(lambda self: (_ for _ in ()).throw(AssertionError("listed"))))
    assert writers.copy_split(str(tmp_path), str(tmp_path / "to"), names) == 1
    assert [(p.name, p.read_bytes()) for p in (tmp_path / "to").iterdir() if not p.name.endswith(".crc")] == [("a.jpg", b"a.jpg")]


def test_strips_are_no_groups_of_their_own(spark):
    tiles = spark.createDataFrame([(1, 2, 4, 0, 0, 2, 4, bytearray(range(24)))], "image_id long, width int, height int, x int, y int, tile_width int, tile_height int, pixels binary")
    rows = reconstruct.strips(tiles, strip_bytes=12)
    assert "FlatMapGroupsInPandas" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [bytes(r.pixels) for r in rows.orderBy("strip").collect()] == [bytes(range(12)), bytes(range(12, 24))]

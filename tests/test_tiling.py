import pytest
from pyspark.sql import functions as F

from gridloom.operators import tiling as G

#: (width, height), mode, grid, tile, xs, ys, redundancy in per cent
GOLDEN = [
    ((4032, 2268), "sahi", (8, 4), (640, 640), [0, 544, 1088, 1632, 2176, 2720, 3264, 3392], [0, 544, 1088, 1628], 43.33),
    ((800, 600), "sahi", (2, 1), (640, 640), [0, 160], [0], 70.67),
    ((4032, 2268), "asahi", (4, 3), (1137, 841), [0, 965, 1930, 2895], [0, 714, 1427], 25.48),
    ((1920, 1080), "asahi", (3, 2), (713, 585), [0, 604, 1207], [0, 495], 20.69),
    ((2268, 4032), "asahi", (3, 4), (841, 1137), [0, 714, 1427], [0, 965, 1930, 2895], 25.48),
    ((4032, 2268), "asahi_rect", (4, 2), (1136, 1226), [0, 965, 1931, 2896], [0, 1042], 21.84),
    ((4000, 3000), "asahi_rect", (4, 3), (1127, 1112), [0, 958, 1915, 2873], [0, 944, 1888], 25.32),
    ((800, 600), "asahi_rect", (3, 2), (297, 325), [0, 252, 503], [0, 275], 20.66),
]


@pytest.mark.parametrize("size,mode,grid,tile,xs,ys,pct", GOLDEN)
def test_golden_grids(spark, size, mode, grid, tile, xs, ys, pct):
    t = G.Tiling(mode)
    one = spark.createDataFrame([size], "width int, height int")
    g = G.geometry(one, t).first()
    assert (g.cols, g.rows, g.redundancy_pct) == (*grid, pct)
    rows = G.tiles(one, t).collect()
    assert sorted({r.x for r in rows}) == xs and sorted({r.y for r in rows}) == ys
    assert [(r.row_index, r.column_index) for r in rows] == [(i, j) for i in range(grid[1]) for j in range(grid[0])]
    for r in rows:
        assert r.x + r.tile_width <= size[0] and r.y + r.tile_height <= size[1]
        assert (r.tile_width, r.tile_height) == (tile if mode != "sahi" else (min(640, size[0]), min(640, size[1])))


def test_modes(spark):
    one = spark.createDataFrame([(1000, 700), (0, 5), (None, None)], "width int, height int")
    assert G.tiles(one, G.Tiling("none")).count() == 0
    assert G.tiles(one, G.Tiling("anything")).collect() == G.tiles(one, G.Tiling("sahi")).collect()
    assert G.geometry(one.limit(1), G.Tiling("none")).first().tile_size_p == "none"


def test_fixed_side_of_the_threshold():
    assert G.Tiling("asahi", 0.15, (320, 320)).threshold == 640 * (4 - 3 * 0.15) + 1


@pytest.mark.parametrize("overlap", [0.1, 0.15, 0.2, 0.3])
def test_strides_and_coverage(spark, overlap):
    sizes = spark.createDataFrame([(1, 4032, 2268), (2, 1920, 1080), (3, 2560, 1440), (4, 700, 641)], "image_id long, width int, height int")
    for mode in ("sahi", "asahi", "asahi_rect"):
        stats = G.coverage_stats(G.tiles(sizes, G.Tiling(mode, overlap))).join(sizes, "image_id").collect()
        assert len(stats) == 4
        for r in stats:
            assert r.pixels == r.width * r.height and r.min_tiles == 1
            if mode != "sahi":
                assert r.std_tiles < 1.0


def test_single_column_does_not_divide_by_zero(spark):
    one = spark.createDataFrame([(4000, 300)], "width int, height int")
    assert {r.y for r in G.tiles(one, G.Tiling("asahi_rect")).collect()} == {0}


def test_letterbox(spark):
    row = spark.range(1).select(*[c.alias(k) for k, c in G.letterbox(F.lit(64), F.lit(32)).items()]).first()
    assert (row.scale, row.pad_x, row.pad_y) == (10.0, 0, 160)

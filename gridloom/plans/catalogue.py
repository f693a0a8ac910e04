"""The registered queries and the SQL that gives the same rows, over the images, annotations and detections of fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cleaning, crowds, inference, labels, matching, metrics, reports, splits, stats, suppression, sweep, tiling, validation
from . import fixture as X
from .fixture import sql

QUERIES: dict = {}
ORACLES: dict = {}
TILINGS = {m: tiling.Tiling(m) for m in ("sahi", "asahi", "asahi_rect")}
IOU = "greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0.0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0.0)"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Tilings


def tile_sql(mode: str) -> str:
    """Common table expressions tl(image_id, width, height, fold, row_index, column_index, x, y, tile_width, tile_height)."""
    t = TILINGS[mode]
    if mode == "sahi":
        axis = lambda d, i: f"list_sort(list_distinct(list_concat(range(0, greatest({d} - {t.tile[i]}, 0) + 1, {t.stride[i]}), [greatest({d} - {t.tile[i]}, 0)])))"
        return f""", ax AS (SELECT *, {axis('width', 0)} AS xs, {axis('height', 1)} AS ys FROM img),
tl0 AS (SELECT *, unnest(range(len(ys))) AS row_index FROM ax), tl1 AS (SELECT *, ys[row_index + 1] AS y, unnest(range(len(xs))) AS column_index FROM tl0),
tl2 AS (SELECT *, xs[column_index + 1] AS x FROM tl1),
tl AS (SELECT image_id, width, height, fold, row_index, column_index, x, y, least({t.tile[0]}, width - x) AS tile_width, least({t.tile[1]}, height - y) AS tile_height FROM tl2)"""
    plus = "+ 1" if mode == "asahi" else ""
    short = "nl - 1" if mode == "asahi" else "greatest(1, CAST(round_even(nl * least(width, height) / CAST(greatest(width, height) AS DOUBLE), 0) AS INT))"
    side = lambda d, n: f"least(CAST(ceil({d} / ({n} - ({n} - 1) * CAST({t.overlap} AS DOUBLE)) {plus}) AS INT), {d})"
    return f""", g0 AS (SELECT *, CASE WHEN greatest(width, height) > {t.threshold} THEN 4 ELSE 3 END AS nl FROM img),
g1 AS (SELECT *, {short} AS ns FROM g0), g2 AS (SELECT *, CASE WHEN width >= height THEN nl ELSE ns END AS cols, CASE WHEN width >= height THEN ns ELSE nl END AS rws FROM g1),
g3 AS (SELECT *, {side('width', 'cols')} AS tile_width, {side('height', 'rws')} AS tile_height FROM g2),
tl0 AS (SELECT *, unnest(range(rws)) AS row_index FROM g3), tl1 AS (SELECT *, unnest(range(cols)) AS column_index FROM tl0),
tl AS (SELECT image_id, width, height, fold, row_index, column_index, CAST(round_even(column_index * (width - tile_width) / CAST(greatest(cols - 1, 1) AS DOUBLE), 0) AS INT) AS x,
  CAST(round_even(row_index * (height - tile_height) / CAST(greatest(rws - 1, 1) AS DOUBLE), 0) AS INT) AS y, tile_width, tile_height FROM tl1)"""


def _tiled(spark, d, mode):
    return tiling.tiles(X.images(spark, d).select("image_id", "width", "height", "fold"), TILINGS[mode])


for _mode in TILINGS:
    query(f"tiles_{_mode}", sql(tile_sql(_mode) + " SELECT image_id, row_index, column_index, x, y, tile_width, tile_height FROM tl"))(
        lambda spark, d, m=_mode: _tiled(spark, d, m).select("image_id", "row_index", "column_index", "x", "y", "tile_width", "tile_height")
    )
    _area = "max(tile_width) * max(tile_height)" if _mode != "sahi" else str(640 * 640)
    _name = "'640'" if _mode == "sahi" else "max(tile_width) || 'x' || max(tile_height)"
    query(
        f"geometry_{_mode}",
        sql(tile_sql(_mode) + f""", one AS (SELECT width, height, min(image_id) AS i FROM img GROUP BY ALL)
SELECT tl.width, tl.height, {_name} AS tile_size_p, CAST(count(DISTINCT x) AS INT) AS cols, CAST(count(DISTINCT y) AS INT) AS rows, CAST(count(*) AS INT) AS tiles_per_image,
  CAST(greatest(0, count(*) * {_area} - tl.width * tl.height) AS BIGINT) AS redundant_pixels FROM tl JOIN one ON image_id = i GROUP BY tl.width, tl.height"""),
    )(lambda spark, d, m=_mode: tiling.geometry(X.images(spark, d).select("width", "height").distinct(), TILINGS[m]).drop("redundancy_pct"))


@query("resolution_histogram", sql("SELECT width, height, count(*) AS n_images FROM dimg WHERE width > 0 AND height > 0 GROUP BY ALL"))
def _(spark, d):
    return tiling.resolution_histogram(X.dirty_images(spark, d))


@query("edge_coverage", sql(tile_sql("sahi") + """, p AS (SELECT image_id, 'x' AS axis, list_sort(list_distinct(list(x))) AS p FROM tl GROUP BY ALL UNION ALL SELECT image_id, 'y', list_sort(list_distinct(list(y))) FROM tl GROUP BY ALL),
q AS (SELECT image_id, axis, p[-2] AS last_regular_position, p[-1] AS anchor_position, p[-1] - p[-2] AS gap_px FROM p WHERE len(p) >= 2)
SELECT *, 96 AS nominal_overlap_px, 640 - gap_px AS actual_overlap_px, 544 - gap_px AS extra_overlap_px, 544 > gap_px AS has_extra FROM q"""))
def _(spark, d):
    return tiling.edge_coverage(_tiled(spark, d, "sahi"), TILINGS["sahi"], ["image_id"])


@query("tile_overlaps", sql(tile_sql("asahi") + """, n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY row_index, column_index) AS tile FROM tl)
SELECT a.image_id, a.tile AS a_tile, b.tile AS b_tile, greatest(a.x, b.x) AS x1, greatest(a.y, b.y) AS y1, least(a.x + a.tile_width, b.x + b.tile_width) AS x2, least(a.y + a.tile_height, b.y + b.tile_height) AS y2
FROM n a JOIN n b ON a.image_id = b.image_id AND a.tile < b.tile AND a.x < b.x + b.tile_width AND b.x < a.x + a.tile_width AND a.y < b.y + b.tile_height AND b.y < a.y + a.tile_height"""))
def _(spark, d):
    return tiling.tile_overlaps(_tiled(spark, d, "asahi"))


@query("coverage_map_stats", sql(tile_sql("asahi") + """, r AS (SELECT DISTINCT width, height, min(image_id) OVER (PARTITION BY width, height) AS i FROM img),
t AS (SELECT tl.* FROM tl JOIN r ON image_id = i), ex AS (SELECT image_id, x AS e FROM t UNION SELECT image_id, x + tile_width FROM t), ey AS (SELECT image_id, y AS e FROM t UNION SELECT image_id, y + tile_height FROM t),
cx AS (SELECT image_id, e AS a, lead(e) OVER (PARTITION BY image_id ORDER BY e) AS b FROM ex), cy AS (SELECT image_id, e AS a, lead(e) OVER (PARTITION BY image_id ORDER BY e) AS b FROM ey),
c AS (SELECT cx.image_id, (cx.b - cx.a) * CAST(cy.b - cy.a AS BIGINT) AS area, count(*) AS n FROM cx JOIN cy USING (image_id) JOIN t USING (image_id) WHERE cx.b IS NOT NULL AND cy.b IS NOT NULL
  AND t.x <= cx.a AND cx.b <= t.x + t.tile_width AND t.y <= cy.a AND cy.b <= t.y + t.tile_height GROUP BY cx.image_id, cx.a, cx.b, cy.a, cy.b),
s AS (SELECT image_id, CAST(sum(area) AS BIGINT) AS pixels, sum(n * area) / CAST(sum(area) AS DOUBLE) AS m, sum(n * n * area) / CAST(sum(area) AS DOUBLE) AS q, min(n) AS min_tiles, max(n) AS max_tiles FROM c GROUP BY image_id)
SELECT image_id, pixels, round(m, 6) AS mean_tiles, round(sqrt(greatest(q - m * m, 0)), 6) AS std_tiles, min_tiles, max_tiles FROM s"""))
def _(spark, d):
    own = X.images(spark, d)
    first = own.groupBy("width", "height").agg(F.min("image_id").alias("image_id"))
    return rounded(tiling.coverage_stats(tiling.tiles(first, TILINGS["asahi"])), "mean_tiles", "std_tiles")


@query("position_gaps", sql(tile_sql("sahi") + """, p AS (SELECT DISTINCT image_id, x AS position FROM tl), g AS (SELECT *, position - lag(position) OVER (PARTITION BY image_id ORDER BY position) AS gap FROM p) SELECT * FROM g WHERE gap IS NOT NULL"""))
def _(spark, d):
    return tiling.position_gaps(_tiled(spark, d, "sahi"))


@query("large_enough_images", sql("SELECT image_id FROM img WHERE width >= 1600 AND height >= 900"))
def _(spark, d):
    return tiling.large_enough(X.images(spark, d), (1600, 900)).select("image_id")


@query("tile_files", sql(tile_sql("asahi_rect") + " SELECT image_id, 'img_' || image_id || '_tile_' || x || '_' || y || '.jpg' AS tile_file FROM tl"))
def _(spark, d):
    return tiling.tile_names(tiling.tiles(X.images(spark, d), TILINGS["asahi_rect"])).select("image_id", "tile_file")


# Cleaning and validation

_SEEN = """, j AS (SELECT d.*, m.id IS NOT NULL AS known, m.width AS mw, m.height AS mh FROM dirty d LEFT JOIN dimg m ON d.image_id = m.id),
k AS (SELECT *, coalesce(mw, 0) > 0 AND coalesce(mh, 0) > 0 AS sized FROM j),
c AS (SELECT *, CASE WHEN sized THEN greatest(0, least(x, mw)) ELSE x END AS x1, CASE WHEN sized THEN greatest(0, least(y, mh)) ELSE y END AS y1,
  CASE WHEN sized THEN greatest(0, least(x + w, mw)) - greatest(0, least(x, mw)) ELSE w END AS w1, CASE WHEN sized THEN greatest(0, least(y + h, mh)) - greatest(0, least(y, mh)) ELSE h END AS h1 FROM k),
e AS (SELECT *, CASE WHEN NOT known THEN 'unknown_image' WHEN category_id = 99 THEN 'unknown_category' WHEN short THEN 'malformed_bbox' WHEN w1 <= 0 OR h1 <= 0 THEN 'degenerate_bbox' END AS reason FROM c),
seen AS (SELECT *, (reason IS NULL OR reason = 'degenerate_bbox') AND sized AND (x1 <> x OR y1 <> y OR w1 <> w OR h1 <> h) AS clamped, reason IS NULL AND (area IS NULL OR abs(area - w1 * h1) > 1.0) AS area_fixed FROM e)"""


def _seen(spark, d):
    return cleaning.examined(X.dirty_images(spark, d).drop("disk_width", "disk_height"), X.dirty_annotations(spark, d), X.categories(spark))


@query("clean_annotations", sql(_SEEN + " SELECT id, image_id, category_id, x1 AS x, y1 AS y, w1 AS w, h1 AS h, CASE WHEN area_fixed THEN w1 * h1 ELSE area END AS area FROM seen WHERE reason IS NULL"))
def _(spark, d):
    own = cleaning.cleaned(X.dirty_images(spark, d), X.dirty_annotations(spark, d), X.categories(spark))
    return own.select("id", "image_id", "category_id", "x", "y", "w", "h", "area")


_COUNT = lambda c, n: f"count(*) FILTER (WHERE {c}) AS {n}"


@query("clean_report", sql(_SEEN + " SELECT count(*) AS total, " + ", ".join([_COUNT("reason IS NULL", "kept"), *[_COUNT(f"reason = '{r}'", r) for r in cleaning.REASONS], _COUNT("clamped", "clamped"), _COUNT("area_fixed", "area_fixed")]) + " FROM seen"))
def _(spark, d):
    return cleaning.report(_seen(spark, d))


@query("missing_files", sql("SELECT file_name FROM img WHERE file_name NOT IN (SELECT file_name FROM files)"))
def _(spark, d):
    return cleaning.missing(X.images(spark, d), X.listing(spark, d)).select("file_name")


@query("orphan_files", sql("SELECT file_name FROM files WHERE file_name NOT IN (SELECT file_name FROM img)"))
def _(spark, d):
    return cleaning.orphans(X.images(spark, d), X.listing(spark, d))


@query("filled_dimensions", sql("SELECT id, CASE WHEN id % 41 <> 0 THEN width WHEN id % 53 <> 0 THEN disk_width END AS width, CASE WHEN id % 41 <> 0 THEN height WHEN id % 53 <> 0 THEN disk_height END AS height FROM dimg"))
def _(spark, d):
    own = X.dirty_images(spark, d)
    disk = own.filter("id % 53 <> 0").select("file_name", "disk_width", "disk_height")
    return cleaning.filled(own.drop("disk_width", "disk_height"), disk).select("id", "width", "height")


@query("simple_clean", sql("SELECT image_id AS id, CASE WHEN image_id % 53 = 0 THEN 'no_file' WHEN image_id NOT IN (SELECT image_id FROM dirty WHERE image_id % 3 = 1) THEN 'no_annotation' ELSE 'kept' END AS status FROM img"))
def _(spark, d):
    own = X.images(spark, d).select(F.col("image_id").alias("id"), "file_name")
    return cleaning.simple_clean(own, X.dirty_annotations(spark, d).filter("image_id % 3 = 1"), X.listing(spark, d)).select("id", "status")


@query("used_categories", sql("SELECT i AS id, 'class_' || i AS name FROM range(1, 5) t(i) WHERE i IN (SELECT category_id FROM ann)"))
def _(spark, d):
    return cleaning.used_categories(X.categories(spark), X.annotations(spark, d))


def _found(spark, d):
    return validation.findings(X.dirty_images(spark, d), X.dirty_annotations(spark, d), X.categories(spark), X.listing(spark, d))


_RULES = """, v0 AS (SELECT d.*, m.id IS NOT NULL AND m.id % 53 <> 0 AS known, m.width AS mw, m.height AS mh FROM dirty d LEFT JOIN dimg m ON d.image_id = m.id),
v AS (SELECT *, known AND NOT short AS further, coalesce(mw, 0) > 0 AND coalesce(mh, 0) > 0 AS sized FROM v0),
found AS (SELECT 'error' AS severity, 'unknown_image' AS rule FROM v WHERE NOT known UNION ALL SELECT 'error', 'unknown_category' FROM v WHERE known AND category_id = 99
UNION ALL SELECT 'error', 'malformed_bbox' FROM v WHERE known AND short UNION ALL SELECT 'error', 'empty_bbox' FROM v WHERE further AND (w <= 0 OR h <= 0)
UNION ALL SELECT 'warning', 'negative_origin' FROM v WHERE further AND (x < 0 OR y < 0) UNION ALL SELECT 'warning', 'out_of_bounds' FROM v WHERE further AND sized AND (x + w > mw OR y + h > mh)
UNION ALL SELECT 'warning', 'area_mismatch' FROM v WHERE further AND area IS NOT NULL AND abs(area - w * h) > 1.0 UNION ALL SELECT 'error', 'missing_file' FROM img WHERE image_id % 53 = 0
UNION ALL SELECT 'warning', 'no_dimensions' FROM dimg WHERE width IS NULL UNION ALL SELECT 'warning', 'orphan_file' FROM range(3) t(i))"""


@query("validate_report", sql(_RULES + " SELECT severity, rule, count(*) AS n_findings FROM found GROUP BY ALL"))
def _(spark, d):
    return validation.report(_found(spark, d))


@query("validate_status", sql(_RULES + " SELECT 'errors' AS status, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM found"))
def _(spark, d):
    return validation.status(_found(spark, d))


@query("generated_integrity", sql("""SELECT 'missing_file' AS rule, count(*) AS n_findings FROM img WHERE image_id % 53 = 0 UNION ALL SELECT 'bad_bbox', count(*) FROM ann WHERE x < 0 OR y < 0 OR w <= 0 OR h <= 0
UNION ALL SELECT 'out_of_bounds', count(*) FROM ann WHERE x + w > width + 1.0 OR y + h > height + 1.0"""))
def _(spark, d):
    own = X.annotations(spark, d).select(F.col("ann_id").alias("id"), "image_id", "x", "y", "w", "h")
    return validation.generated(X.images(spark, d).withColumnRenamed("image_id", "id"), own, X.listing(spark, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("n_findings"))


@query("set_differences", sql("SELECT 'left' AS side, file_name AS value FROM img WHERE image_id % 53 = 0 UNION ALL SELECT 'right', 'stray_' || i || '.jpg' FROM range(3) t(i)"))
def _(spark, d):
    return validation.differences(X.images(spark, d), X.listing(spark, d), "file_name")


# Splits

_POS = "row_number() OVER (ORDER BY (image_id + 42) * 2654435761 % 4294967296, image_id) - 1"
_KFOLD = f""", p AS (SELECT image_id, {_POS} AS pos, count(*) OVER () AS n FROM img), q AS (SELECT *, n // 5 AS s, n % 5 AS r FROM p),
c AS (SELECT *, CASE WHEN pos < r * (s + 1) THEN pos // (s + 1) ELSE r + (pos - r * (s + 1)) // greatest(s, 1) END AS chunk FROM q),
f AS (SELECT *, unnest(range(5)) AS split_fold FROM c), t AS (SELECT *, s + CASE WHEN split_fold < r THEN 1 ELSE 0 END AS n_test FROM f),
u AS (SELECT *, CASE WHEN chunk < split_fold THEN pos ELSE pos - n_test END AS pool, greatest(1, CAST(round_even((n - n_test) * CAST(0.15 AS DOUBLE), 0) AS BIGINT)) AS n_val FROM t),
sp AS (SELECT image_id, split_fold, CASE WHEN chunk = split_fold THEN 'test' WHEN pool < n_val THEN 'val' ELSE 'train' END AS split FROM u)"""


@query("kfold_assign", sql(_KFOLD + " SELECT * FROM sp"))
def _(spark, d):
    return splits.kfold_holdout(X.images(spark, d).select("image_id"))


@query("kfold_sizes", sql(_KFOLD + " SELECT split_fold, split, count(*) AS n_images FROM sp GROUP BY ALL"))
def _(spark, d):
    return splits.kfold_holdout(X.images(spark, d).select("image_id")).groupBy("split_fold", "split").agg(F.count(F.lit(1)).alias("n_images"))


def _feistel(x: str) -> str:
    return f"list_reduce(CAST([{x}, {', '.join(map(str, splits.round_keys(42)))}] AS BIGINT[]), lambda a, k: ((a & ((1 << h) - 1)) << h) + xor(a >> h, (((((a & ((1 << h) - 1)) + k) * 2654435761) % 4294967296) >> 8) & ((1 << h) - 1)))"


_PERMUTED = f""", p0 AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS i, count(*) OVER () AS n FROM img), p1 AS (SELECT *, (SELECT CAST(min(k) AS INT) FROM range(1, 32) t(k) WHERE power(4, k) >= (SELECT max(n) FROM p0)) AS h FROM p0),
wk AS (SELECT image_id, n, h, {_feistel('i')} AS x FROM p1 UNION ALL SELECT image_id, n, h, {_feistel('x')} FROM wk WHERE x >= n), pm AS (SELECT image_id, x AS pos, n FROM wk WHERE x < n)"""


@query("kfold_permuted", sql(_PERMUTED + _KFOLD.replace(_KFOLD[: _KFOLD.index(", q AS")], "").replace("FROM p)", "FROM pm)", 1) + " SELECT * FROM sp"))
def _(spark, d):
    return splits.kfold_permuted(X.images(spark, d).select("image_id"))


@query("fixed_ratio_assign", sql(""", f AS (SELECT image_id, unnest(range(5)) AS split_fold FROM img), g AS (SELECT *, image_id + split_fold * 7919 AS h FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY split_fold ORDER BY (h + 42) * 2654435761 % 4294967296, h) - 1 AS pos, count(*) OVER (PARTITION BY split_fold) AS n FROM g),
s AS (SELECT *, greatest(1, CAST(round_even(n * CAST(0.2 AS DOUBLE), 0) AS BIGINT)) AS t, greatest(1, CAST(round_even(n * CAST(0.15 AS DOUBLE), 0) AS BIGINT)) AS v FROM p)
SELECT image_id, split_fold, CASE WHEN pos < t THEN 'test' WHEN pos < t + v THEN 'val' ELSE 'train' END AS split FROM s"""))
def _(spark, d):
    return splits.fixed_ratios(X.images(spark, d).select("image_id"))


@query("split_audit", sql(_KFOLD + """, n AS (SELECT split_fold, split, count(*) AS n FROM sp GROUP BY ALL), a AS (SELECT split_fold, sum(n) AS a FROM n GROUP BY ALL),
e AS (SELECT n.*, CAST(CASE split WHEN 'val' THEN round_even(a * CAST(0.15 AS DOUBLE), 0) WHEN 'test' THEN round_even(a * CAST(0.2 AS DOUBLE), 0) ELSE a - round_even(a * CAST(0.15 AS DOUBLE), 0) - round_even(a * CAST(0.2 AS DOUBLE), 0) END AS BIGINT) AS expected FROM n JOIN a USING (split_fold))
SELECT * FROM e WHERE abs(n - expected) > 1"""))
def _(spark, d):
    return splits.audit(splits.kfold_holdout(X.images(spark, d).select("image_id")), 0.15, 0.2)


_EMPTY = tile_sql("asahi") + """, e AS (SELECT image_id * 100 + row_index * 10 + column_index AS tile_id FROM tl WHERE NOT EXISTS (SELECT 1 FROM ann a WHERE a.image_id = tl.image_id AND a.x < tl.x + tile_width AND tl.x < a.x + a.w AND a.y < tl.y + tile_height AND tl.y < a.y + a.h)),
r AS (SELECT tile_id, row_number() OVER (ORDER BY tile_id * 2654435761 % 4294967296, tile_id) AS n FROM e)"""


def _used_and_empty(spark, d):
    tiled = _tiled(spark, d, "asahi").withColumn("tile_id", F.col("image_id") * 100 + F.col("row_index") * 10 + F.col("column_index"))
    own = X.annotations(spark, d).select("ann_id", "image_id", "x", "y", "w", "h", "width", "height")
    used = labels.boxes_on_tiles(own, TILINGS["asahi"], 1e-12).select((F.col("image_id") * 100 + F.col("row_index") * 10 + F.col("column_index")).alias("tile_id")).distinct()
    return used, tiled.join(used.hint("merge"), "tile_id", "left_anti").select("tile_id")  # no table of tiles is broadcast: Spark takes one for as small as its images' file


@query("empty_tile_sample", sql(_EMPTY + " SELECT tile_id FROM r WHERE n <= ceil(1000 * 0.08)"))
def _(spark, d):
    return splits.sample_empty(_used_and_empty(spark, d)[1], 1000, 0.08, "tile_id")


@query("empty_tile_sample_full", sql(_EMPTY + " SELECT tile_id FROM r WHERE n <= (SELECT ceil(((SELECT count(*) FROM tl) - (SELECT count(*) FROM e) + (SELECT count(*) FROM img)) * CAST(0.08 AS DOUBLE)))"))
def _(spark, d):
    """As empty_tile_sample, in proportion to the annotated samples: the tiles with a box, and each image as a whole."""
    used, empty = _used_and_empty(spark, d)
    return splits.sample_empty(empty, used.count() + X.images(spark, d).count(), 0.08, "tile_id")


@query("group_kfold", sql(", g AS (SELECT height % 7 AS grp, count(*) AS n FROM img GROUP BY ALL), o AS (SELECT grp, n, row_number() OVER (ORDER BY n DESC, grp) AS k FROM g), b AS (SELECT 1 AS k, [n, 0, 0] AS load, 0 AS f, grp FROM o WHERE k = 1 UNION ALL SELECT o.k, list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + o.n ELSE x END), list_position(load, list_min(load)) - 1, o.grp FROM b JOIN o ON o.k = b.k + 1) SELECT image_id, f AS test_fold FROM b JOIN img ON height % 7 = grp"))
def _(spark, d):
    own = X.images(spark, d).select("image_id", (F.col("height") % 7).alias("grp"))
    return splits.group_kfold(own, "grp", 3).select("image_id", "test_fold")


# Labels

_KEPT = """, kp AS (SELECT a.ann_id, a.category_id, tl.image_id, tl.row_index, tl.column_index, tl.tile_width, tl.tile_height,
  greatest(a.x, tl.x) - tl.x AS cx1, greatest(a.y, tl.y) - tl.y AS cy1, least(a.x + a.w, tl.x + tile_width) - tl.x AS cx2, least(a.y + a.h, tl.y + tile_height) - tl.y AS cy2, a.w * a.h AS area
  FROM ann a JOIN tl ON a.image_id = tl.image_id AND a.x < tl.x + tile_width AND tl.x < a.x + a.w AND a.y < tl.y + tile_height AND tl.y < a.y + a.h),
kept AS (SELECT *, (cx2 - cx1) * (cy2 - cy1) / CAST(area AS DOUBLE) AS ioa FROM kp WHERE (cx2 - cx1) * (cy2 - cy1) / CAST(area AS DOUBLE) >= 0.4)"""
_U = lambda x: f"round(greatest(least({x}, 1.0), 0.0), 13)"


def _kept(spark, d, mode):
    own = X.annotations(spark, d).select("ann_id", "image_id", "category_id", "x", "y", "w", "h", "width", "height", "fold")
    return labels.boxes_on_tiles(own, TILINGS[mode])


@query("tile_labels_ioa", sql(tile_sql("sahi") + _KEPT + f" SELECT image_id, row_index, column_index, ann_id, round(ioa, 13) AS ioa, {_U('(cx1 + (cx2 - cx1) / 2.0) / tile_width')} AS cx, {_U('(cy1 + (cy2 - cy1) / 2.0) / tile_height')} AS cy, {_U('(cx2 - cx1) / CAST(tile_width AS DOUBLE)')} AS bw, {_U('(cy2 - cy1) / CAST(tile_height AS DOUBLE)')} AS bh FROM kept"))
def _(spark, d):
    own = labels.tile_labels(_kept(spark, d, "sahi")).select("image_id", "row_index", "column_index", "ann_id", "ioa", "cx", "cy", "bw", "bh")
    return rounded(own, "ioa", "cx", "cy", "bw", "bh", digits=13)


@query("tile_labels_rect", sql(tile_sql("asahi_rect") + _KEPT + f" SELECT image_id, row_index, column_index, ann_id, round(ioa, 13) AS ioa, {_U('(cx1 + (cx2 - cx1) / 2.0) / tile_width')} AS cx, {_U('(cy1 + (cy2 - cy1) / 2.0) / tile_height')} AS cy FROM kept"))
def _(spark, d):
    return rounded(labels.tile_labels(_kept(spark, d, "asahi_rect")).select("image_id", "row_index", "column_index", "ann_id", "ioa", "cx", "cy"), "ioa", "cx", "cy", digits=13)


@query("touched_tiles", sql(tile_sql("sahi") + " SELECT image_id, ann_id, count(*) AS tiles, CAST(sum(tl.x) AS BIGINT) AS xs, CAST(sum(tl.y) AS BIGINT) AS ys FROM ann a JOIN tl USING (image_id) WHERE a.x < tl.x + tile_width AND tl.x < a.x + a.w AND a.y < tl.y + tile_height AND tl.y < a.y + a.h GROUP BY ALL"))
def _(spark, d):
    """The tiles of each box; all are touched, as fixed tiles are found exactly."""
    rows = tiling.touched_tiles(X.annotations(spark, d), TILINGS["sahi"])
    return rows.groupBy("image_id", "ann_id").agg(F.count(F.lit(1)).alias("tiles"), F.sum("tile_x").alias("xs"), F.sum("tile_y").alias("ys"))


def _box_sql(w: str, h: str, x: str, y: str, bw: str, bh: str) -> str:
    s = f"least(640.0::DOUBLE / {w}, 640.0::DOUBLE / {h})"
    pad = lambda v: f"floor((640 - CAST(trunc({v} * {s}) AS INT)) / 2.0)"
    return f"{_U(f'(({x} + {bw} / 2.0::DOUBLE) * {s} + {pad(w)}) / 640')} AS cx, {_U(f'(({y} + {bh} / 2.0::DOUBLE) * {s} + {pad(h)}) / 640')} AS cy, {_U(f'{bw} * {s} / 640')} AS bw, {_U(f'{bh} * {s} / 640')} AS bh"


@query("letterbox_labels", sql(tile_sql("asahi") + _KEPT + f" SELECT image_id, row_index, column_index, ann_id, {_box_sql('tile_width', 'tile_height', 'cx1', 'cy1', '(cx2 - cx1)', '(cy2 - cy1)')} FROM kept"))
def _(spark, d):
    return rounded(labels.letterbox_labels(_kept(spark, d, "asahi")).select("image_id", "row_index", "column_index", "ann_id", "cx", "cy", "bw", "bh"), "cx", "cy", "bw", "bh", digits=13)


@query("full_image_labels", sql(f"SELECT ann_id, {_box_sql('width', 'height', 'x', 'y', 'w', 'h')} FROM ann WHERE w > 0 AND h > 0"))
def _(spark, d):
    return rounded(labels.full_image_labels(X.annotations(spark, d)).select("ann_id", "cx", "cy", "bw", "bh"), "cx", "cy", "bw", "bh", digits=13)


@query("holdout_labels", sql(f"SELECT ann_id, {_U('(x + w / 2.0::DOUBLE) / width')} AS cx, {_U('(y + h / 2.0::DOUBLE) / height')} AS cy, {_U('w / CAST(width AS DOUBLE)')} AS bw, {_U('h / CAST(height AS DOUBLE)')} AS bh FROM ann"))
def _(spark, d):
    return rounded(labels.holdout_labels(X.annotations(spark, d)).select("ann_id", "cx", "cy", "bw", "bh"), "cx", "cy", "bw", "bh", digits=13)


_SQ = lambda v, d: f"greatest(0, least(({v}) * (640.0::DOUBLE / {d}), 640))"


@query("baseline_boxes", sql(f", b AS (SELECT ann_id, CAST(category_id - 1 AS INT) AS cls, {_SQ('x', 'width')} AS a1, {_SQ('y', 'height')} AS b1, {_SQ('x + w', 'width')} AS a2, {_SQ('y + h', 'height')} AS b2 FROM ann) SELECT ann_id, cls, round(a1, 9) AS bx, round(b1, 9) AS by, round(a2 - a1, 9) AS bw, round(b2 - b1, 9) AS bh, round((a1 + (a2 - a1) / 2) / 640, 9) AS cx, round((b2 - b1) / 640, 9) AS nh FROM b WHERE a2 > a1 AND b2 > b1"))
def _(spark, d):
    own = labels.baseline_labels(labels.resized_boxes(X.annotations(spark, d)))
    return rounded(own.select("ann_id", "cls", "bx", "by", "bw", "bh", "cx", "nh"), "bx", "by", "bw", "bh", "cx", "nh", digits=9)


@query("annotations_kept_per_image", sql(tile_sql("asahi") + _KEPT + ", o AS (SELECT image_id, count(*) AS n FROM ann GROUP BY ALL), k AS (SELECT image_id, count(DISTINCT ann_id) AS k FROM kept GROUP BY ALL) SELECT img.image_id, coalesce(n, 0) AS annotations_original, coalesce(k, 0) AS annotations_kept, coalesce(n, 0) - coalesce(k, 0) AS annotations_discarded FROM img LEFT JOIN o USING (image_id) LEFT JOIN k USING (image_id)"))
def _(spark, d):
    return labels.kept_per_image(X.images(spark, d), X.annotations(spark, d), _kept(spark, d, "asahi"))


def _yolo(spark, d):
    own = X.annotations(spark, d)
    c = F.col
    return own.select(F.concat(F.lit("img_"), "image_id", F.lit(".jpg")).alias("file_name"), c("ann_id").alias("line_no"), (c("category_id") - 1).alias("cls"), ((c("x") + c("w") / 2) / c("width")).alias("cx"), ((c("y") + c("h") / 2) / c("height")).alias("cy"), (c("w") / c("width")).alias("w"), (c("h") / c("height")).alias("h"))


@query("coco_from_labels", sql(""", n AS (SELECT image_id, width, height, row_number() OVER (ORDER BY file_name) AS id FROM img),
b AS (SELECT n.id AS image_id, ann_id, category_id, n.width, n.height, (x + w / 2.0::DOUBLE) / n.width AS cx, (y + h / 2.0::DOUBLE) / n.height AS cy, w / CAST(n.width AS DOUBLE) AS w, h / CAST(n.height AS DOUBLE) AS h FROM ann JOIN n USING (image_id)),
q AS (SELECT *, greatest(0, least((cx - w / 2) * width, width)) AS x1, greatest(0, least((cy - h / 2) * height, height)) AS y1 FROM b), z AS (SELECT *, least(w * width, width - x1) AS bw, least(h * height, height - y1) AS bh FROM q)
SELECT row_number() OVER (ORDER BY image_id, ann_id) AS id, image_id, category_id, round(x1, 6) AS x, round(y1, 6) AS y, round(bw, 6) AS bw, round(bh, 6) AS bh, round(bw * bh, 4) AS area FROM z WHERE bw > 0 AND bh > 0"""))
def _(spark, d):
    _, out = labels.to_coco(_yolo(spark, d), X.images(spark, d), 4)
    return rounded(rounded(out, "x", "y", "bw", "bh"), "area", digits=4)


@query("class_index", "SELECT i AS id, 'class_' || i AS name, CAST(i - 1 AS INT) AS cls FROM range(1, 5) t(i)")
def _(spark, d):
    return labels.class_index(X.categories(spark))


@query("original_stem", sql(tile_sql("sahi") + " SELECT 'img_' || image_id AS stem, count(*) AS n FROM tl GROUP BY ALL"))
def _(spark, d):
    own = tiling.tile_names(tiling.tiles(X.images(spark, d), TILINGS["sahi"]))
    return own.groupBy(labels.original_stem(F.col("tile_file")).alias("stem")).agg(F.count(F.lit(1)).alias("n"))


# Detections


@query("reproject_detections", sql(f", p AS (SELECT det_id, {', '.join(f'greatest(least((det.{e} * 640 + {o}) / img.{s}, 1.0), 0.0) AS {e}' for e, o, s in (('x1', 320, 'width'), ('y1', 180, 'height'), ('x2', 320, 'width'), ('y2', 180, 'height')))} FROM det JOIN img USING (image_id)) SELECT det_id, round(x1, 13) AS x1, round(y1, 13) AS y1, round(x2, 13) AS x2, round(y2, 13) AS y2 FROM p WHERE x2 > x1 AND y2 > y1"))
def _(spark, d):
    own = X.detections(spark, d).join(X.images(spark, d).select("image_id", "width", "height"), "image_id").withColumns({"tile_x": F.lit(320), "tile_y": F.lit(180)} | {e: F.col(e) * 640 for e in ("x1", "y1", "x2", "y2")})
    return rounded(inference.reproject(own).select("det_id", "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2", digits=13)


@query("confidence_filter", sql("SELECT 'yolo' AS engine, count(*) AS n FROM det WHERE score >= 0.5 UNION ALL SELECT 'detr', count(*) FROM det WHERE score > 0.5"))
def _(spark, d):
    own = X.detections(spark, d)
    parts = [inference.confident(own, 0.5, e).agg(F.lit(e).alias("engine"), F.count(F.lit(1)).alias("n")) for e in ("yolo", "detr")]
    return parts[0].unionByName(parts[1])


@query("detr_decode", sql(", q AS (SELECT det_id, [score * 4, label * 1.5, 2.0 - score] AS lg FROM det), e AS (SELECT det_id, list_transform(lg, lambda v: exp(v - list_max(lg))) AS ex FROM q), p AS (SELECT det_id, list_transform(ex[1:2], lambda v: v / list_sum(ex)) AS p FROM e) SELECT det_id, CAST(list_position(p, list_max(p)) - 1 AS INT) AS label, round(list_max(p), 6) AS score FROM p WHERE list_max(p) > 0.5"))
def _(spark, d):
    own = X.detections(spark, d).select("det_id", F.array(F.col("score") * 4, F.col("label") * 1.5, 2.0 - F.col("score")).alias("logits"))
    return rounded(inference.decode_queries(own, 0.5).select("det_id", "label", "score"), "score")


@query("pixel_boxes", sql("SELECT det_id, CAST(trunc(x1 * width) AS INT) AS px_x1, CAST(trunc(y2 * height) AS INT) AS px_y2 FROM det JOIN img USING (image_id)"))
def _(spark, d):
    own = X.detections(spark, d).join(X.images(spark, d).select("image_id", "width", "height"), "image_id")
    return inference.pixels(own).select("det_id", "px_x1", "px_y2")


@query("model_engines", "SELECT * FROM (VALUES ('YOLOV8N', 'yolo'), ('fasterRCNN', 'faster_rcnn'), ('Detr', 'detr'), ('other', NULL)) t(model, engine)")
def _(spark, d):
    own = spark.createDataFrame([("YOLOV8N",), ("fasterRCNN",), ("Detr",), ("other",)], "model string")
    return own.withColumn("engine", inference.engine_of(F.col("model")))


def iou_of(a: str, b: str, eps: str = "") -> str:
    both = IOU.format(a=a, b=b)
    area = lambda p: f"({p}.x2 - {p}.x1) * ({p}.y2 - {p}.y1)"
    union = f"({area(a)} + {area(b)} - {both}{eps})"
    return f"{both} / {union}" if eps else f"CASE WHEN {union} > 0 THEN {both} / {union} ELSE 0.0 END"


def diou_of(a: str, b: str) -> str:
    dist = "+".join(f"(({a}.{c}1 + {a}.{c}2) / 2 - ({b}.{c}1 + {b}.{c}2) / 2) * (({a}.{c}1 + {a}.{c}2) / 2 - ({b}.{c}1 + {b}.{c}2) / 2)" for c in "xy")
    diag = "+".join(f"(greatest({a}.{c}2, {b}.{c}2) - least({a}.{c}1, {b}.{c}1)) * (greatest({a}.{c}2, {b}.{c}2) - least({a}.{c}1, {b}.{c}1))" for c in "xy")
    return f"{iou_of(a, b, ' + 1e-7')} - ({dist}) / ({diag} + 1e-7)"


def kept_sql(by: str, like: str, where: str = "TRUE") -> str:
    """Common table expressions nms(det_id): the greedy fold over each group."""
    return f""", grp AS (SELECT {by}, list(struct_pack(d := det_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2) ORDER BY score DESC, det_id) AS l FROM det WHERE {where} GROUP BY {by}),
fold_ AS (SELECT {by}, l, 1 AS i, [l[1]] AS kept FROM grp UNION ALL SELECT {by}, l, i + 1, CASE WHEN len(list_filter(kept, lambda k: ({like.replace('B.', 'l[i + 1].').replace('A.', 'k.')}) > 0.5)) = 0 THEN list_append(kept, l[i + 1]) ELSE kept END FROM fold_ WHERE i < len(l)),
nms AS (SELECT k.d AS det_id FROM (SELECT unnest(kept) AS k FROM fold_ WHERE i = len(l)))"""


NMS = kept_sql("image_id, label", iou_of("A", "B"))


@query("nms_per_class", sql(NMS + " SELECT det_id FROM nms"))
def _(spark, d):
    return suppression.nms(X.detections(spark, d)).select("det_id")


@query("cluster_diou_nms", sql(kept_sql("image_id", diou_of("A", "B")) + " SELECT det_id FROM nms"))
def _(spark, d):
    return suppression.cluster_diou_nms(X.detections(spark, d)).select("det_id")


@query("nms_in_rounds", sql(NMS + " SELECT det_id FROM nms"))
def _(spark, d):
    """Images cut into strips of about eight boxes."""
    return crowds.nms(X.detections(spark, d), crowd=8).select("det_id")


@query("cluster_diou_in_rounds", sql(kept_sql("image_id", diou_of("A", "B")) + " SELECT det_id FROM nms"))
def _(spark, d):
    return crowds.cluster_diou_nms(X.detections(spark, d), crowd=8).select("det_id")


@query("bws", sql(NMS + f""", s AS (SELECT det.* FROM det JOIN nms USING (det_id)), pr AS (SELECT a.det_id, a.score, a.x1, a.y1, a.x2, a.y2, s.det_id AS seed, row_number() OVER (PARTITION BY a.det_id ORDER BY s.score DESC, s.det_id) AS n
FROM det a JOIN s ON a.image_id = s.image_id AND a.label = s.label WHERE a.det_id = s.det_id OR ({iou_of('s', 'a')}) > 0.5)
SELECT seed AS det_id, max(score) AS score, {', '.join(f'round(sum({e} * score) / sum(score), 9) AS {e}' for e in ('x1', 'y1', 'x2', 'y2'))} FROM pr WHERE n = 1 GROUP BY seed"""))
def _(spark, d):
    return rounded(suppression.bws(X.detections(spark, d)).select("det_id", "score", "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2", digits=9)


@query("adaptive_diou_nms")
def _(spark, d):
    return suppression.adaptive_nms(X.detections(spark, d)).select("det_id")


@query("wbf")
def _(spark, d):
    return suppression.wbf(X.detections(spark, d)).select("image_id", "label", "det_id", "score", "x1", "y1", "x2", "y2")


@query("wbf_skipped", sql("SELECT count(*) AS n FROM det WHERE score < 0.001"))
def _(spark, d):
    return X.detections(spark, d).filter(F.col("score") < suppression.EPS_SKIP).agg(F.count(F.lit(1)).alias("n"))


# Matching and metrics

BEST = f""", pr AS (SELECT det.image_id, det.fold, det.det_id, det.score, gt.gt_id, {iou_of('det', 'gt')} AS iou FROM det JOIN gt ON det.image_id = gt.image_id AND det.x1 < gt.x2 AND gt.x1 < det.x2 AND det.y1 < gt.y2 AND gt.y1 < det.y2),
br AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, gt_id) AS n FROM pr),
best AS (SELECT det.image_id, det.fold, det.det_id, det.score, br.gt_id, br.iou FROM det LEFT JOIN br ON det.det_id = br.det_id AND br.n = 1)"""
MATCH = BEST + """, mt AS (SELECT *, coalesce(iou >= 0.5, FALSE) AS near FROM best),
matches AS (SELECT *, near AND row_number() OVER (PARTITION BY image_id, gt_id, near ORDER BY score DESC, det_id) = 1 AS is_tp FROM mt)"""


def _matches(spark, d):
    return matching.match(X.detections(spark, d), X.truths(spark, d))


@query("greedy_match", sql(MATCH + " SELECT det_id, gt_id, is_tp FROM matches"))
def _(spark, d):
    return _matches(spark, d).select("det_id", "gt_id", "is_tp")


@query("missed_truths", sql(MATCH + " SELECT gt_id FROM gt WHERE NOT EXISTS (SELECT 1 FROM matches WHERE is_tp AND matches.gt_id = gt.gt_id)"))
def _(spark, d):
    return matching.missed(_matches(spark, d), X.truths(spark, d)).select("gt_id")


ROWS = MATCH + """, cr AS (SELECT img.image_id, img.fold, coalesce(g, 0) AS groundtruth, coalesce(p, 0) AS raw_predicted, coalesce(p, 0) AS predicted, coalesce(t, 0) AS tp FROM img
LEFT JOIN (SELECT image_id, count(*) AS g FROM gt GROUP BY ALL) USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS p, count(*) FILTER (WHERE is_tp) AS t FROM matches GROUP BY ALL) USING (image_id)),
counts AS (SELECT *, 0 AS removed_by_suppression, predicted - tp AS fp, groundtruth - tp AS fn FROM cr)"""


def _rows(spark, d):
    own = X.detections(spark, d)
    return matching.counting(X.images(spark, d), X.truths(spark, d), own, _matches(spark, d))


@query("counting_rows", sql(ROWS + " SELECT image_id, groundtruth, raw_predicted, predicted, removed_by_suppression, tp, fp, fn FROM counts"))
def _(spark, d):
    return _rows(spark, d)


@query("precision_recall", sql(ROWS + ", s AS (SELECT fold, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM counts GROUP BY ALL), q AS (SELECT *, tp / (tp + fp + 1e-9) AS p, tp / (tp + fn + 1e-9) AS r FROM s) SELECT fold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-9), 6) AS fscore FROM q"))
def _(spark, d):
    own = _rows(spark, d).join(X.images(spark, d).select("image_id", "fold"), "image_id")
    return rounded(metrics.prf(own, ("fold",)), "precision", "recall", "fscore")


@query("counting_errors", sql(ROWS + " SELECT fold, round(avg(abs(predicted - groundtruth)), 6) AS mae, round(sqrt(avg((predicted - groundtruth) * (predicted - groundtruth))), 6) AS rmse, round(CASE WHEN count(*) <= 1 OR stddev_pop(groundtruth) = 0 THEN 0 ELSE corr(predicted, groundtruth) END, 6) AS pearson_r, round(avg(CASE WHEN groundtruth > 0 THEN abs(predicted - groundtruth) / CAST(groundtruth AS DOUBLE) END) * 100, 6) AS mape FROM counts GROUP BY fold"))
def _(spark, d):
    own = _rows(spark, d).join(X.images(spark, d).select("image_id", "fold"), "image_id")
    return rounded(metrics.pooled_errors(own, ("fold",)), "mae", "rmse", "pearson_r", "mape")


AP = BEST + f""", th AS (SELECT unnest([{', '.join(f'{t!r}::DOUBLE' for t in metrics.IOU_THRESHOLDS)}]) AS iou_threshold),
lb AS (SELECT best.*, iou_threshold, coalesce(iou >= iou_threshold, FALSE) AS near FROM best, th), lt AS (SELECT *, near AND row_number() OVER (PARTITION BY iou_threshold, image_id, gt_id, near ORDER BY score DESC, det_id) = 1 AS is_tp FROM lb),
cm AS (SELECT fold, iou_threshold, sum(CASE WHEN is_tp THEN 1 ELSE 0 END) OVER w AS hits, row_number() OVER w AS seen FROM lt WINDOW w AS (PARTITION BY fold, iou_threshold ORDER BY score DESC, image_id, det_id ROWS UNBOUNDED PRECEDING)),
ng AS (SELECT fold, count(*) AS n_gt FROM gt GROUP BY ALL), rp AS (SELECT cm.fold, iou_threshold, hits / CAST(n_gt AS DOUBLE) AS rec, hits / (seen + 1e-9) AS prec FROM cm JOIN ng USING (fold)),
ul AS (SELECT fold, iou_threshold, rec, max(prec) AS prec FROM rp GROUP BY ALL), lv AS (SELECT i * CAST(0.01 AS DOUBLE) AS lv FROM range(101) t(i)),
mx AS (SELECT fold, iou_threshold, lv, max(CASE WHEN rec >= lv THEN prec ELSE 0 END) AS m FROM ul, lv GROUP BY ALL), ap AS (SELECT fold, iou_threshold, sum(m) / 101 AS ap FROM mx GROUP BY ALL)"""


def _found_ap(spark, d):
    keys = ("fold", "image_id")
    truths = X.truths(spark, d)
    n = truths.groupBy("fold").agg(F.count(F.lit(1)).alias("n_gt"))
    return metrics.average_precision(matching.best_truth(X.detections(spark, d), truths, keys), n, ("fold",))


@query("average_precision", sql(AP + " SELECT fold, round(iou_threshold, 2) AS iou_threshold, round(ap, 6) AS ap FROM ap"))
def _(spark, d):
    return rounded(rounded(_found_ap(spark, d), "ap"), "iou_threshold", digits=2)


@query("map_summary", sql(AP + f" SELECT fold, round(max(CASE WHEN iou_threshold = 0.5 THEN ap END), 6) AS map50, round(max(CASE WHEN iou_threshold = {metrics.IOU_THRESHOLDS[5]!r}::DOUBLE THEN ap END), 6) AS map75, round(avg(ap), 6) AS map FROM ap GROUP BY fold"))
def _(spark, d):
    return rounded(metrics.map_summary(_found_ap(spark, d), ("fold",)), "map50", "map75", "map")


# Sweeps

STEPS = [0.2, 0.4, 0.6, 0.8]


def sweep_sql(steps: list[float]) -> str:
    """Common table expressions fm(threshold, fold, five metrics) and cv(threshold, five metrics)."""
    return NMS + f""", once AS (SELECT det.* FROM det JOIN nms USING (det_id) WHERE score >= {min(steps)}), st AS (SELECT unnest({steps}::DOUBLE[]) AS threshold),
pr AS (SELECT o.image_id, o.fold, o.det_id, o.score, gt.gt_id, {iou_of('o', 'gt')} AS iou FROM once o JOIN gt ON o.image_id = gt.image_id AND o.x1 < gt.x2 AND gt.x1 < o.x2 AND o.y1 < gt.y2 AND gt.y1 < o.y2),
br AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, gt_id) AS n FROM pr),
bt AS (SELECT o.image_id, o.fold, o.det_id, o.score, br.gt_id, coalesce(br.iou >= 0.5, FALSE) AS near, threshold FROM once o LEFT JOIN br ON o.det_id = br.det_id AND br.n = 1 JOIN st ON o.score >= threshold),
mt AS (SELECT *, near AND row_number() OVER (PARTITION BY threshold, image_id, gt_id, near ORDER BY score DESC, det_id) = 1 AS is_tp FROM bt),
ci AS (SELECT st.threshold, img.fold, img.image_id, coalesce(g, 0) AS g, coalesce(p, 0) AS p, coalesce(t, 0) AS t FROM st CROSS JOIN img LEFT JOIN (SELECT image_id, count(*) AS g FROM gt GROUP BY ALL) USING (image_id)
  LEFT JOIN (SELECT threshold, image_id, count(*) AS p, count(*) FILTER (WHERE is_tp) AS t FROM mt GROUP BY ALL) x ON x.threshold = st.threshold AND x.image_id = img.image_id),
cs AS (SELECT threshold, fold, sum(t) AS tp, sum(p - t) AS fp, sum(g - t) AS fn, avg(abs(p - g)) AS mae FROM ci GROUP BY ALL),
pq AS (SELECT *, tp / (tp + fp + 1e-9) AS precision, tp / (tp + fn + 1e-9) AS recall FROM cs),
cm AS (SELECT threshold, fold, sum(CASE WHEN is_tp THEN 1 ELSE 0 END) OVER w AS hits, row_number() OVER w AS seen FROM mt WINDOW w AS (PARTITION BY threshold, fold ORDER BY score DESC, image_id, det_id ROWS UNBOUNDED PRECEDING)),
ng AS (SELECT fold, count(*) AS n_gt FROM gt GROUP BY ALL), rp AS (SELECT threshold, cm.fold, hits / CAST(n_gt AS DOUBLE) AS rec, hits / (seen + 1e-9) AS prec FROM cm JOIN ng USING (fold)),
ul AS (SELECT threshold, fold, rec, max(prec) AS prec FROM rp GROUP BY ALL), lv AS (SELECT i * CAST(0.01 AS DOUBLE) AS lv FROM range(101) t(i)),
ap AS (SELECT threshold, fold, sum(m) / 101 AS map50 FROM (SELECT threshold, fold, lv, max(CASE WHEN rec >= lv THEN prec ELSE 0 END) AS m FROM ul, lv GROUP BY ALL) GROUP BY ALL),
fm AS (SELECT threshold, fold, coalesce(map50, 0) AS map50, precision, recall, 2 * precision * recall / (precision + recall + 1e-9) AS fscore, mae FROM pq LEFT JOIN ap USING (threshold, fold)),
cv AS (SELECT threshold, avg(map50) AS map50, avg(precision) AS precision, avg(recall) AS recall, avg(fscore) AS fscore, avg(mae) AS mae FROM fm GROUP BY threshold)"""


_FIVE = ("map50", "precision", "recall", "fscore", "mae")
_R = ", ".join(f"round({c}, 5) AS {c}" for c in _FIVE)


def _fold_metrics(spark, d, steps):
    return sweep.fold_metrics(X.images(spark, d), X.detections(spark, d), X.truths(spark, d), steps)


def _sweep_queries(suffix: str, steps: list[float]) -> None:
    swept = sweep_sql(steps)

    @query(f"sweep_fold_metrics{suffix}", sql(swept + f" SELECT threshold, fold, {_R} FROM fm"))
    def _(spark, d):
        return rounded(_fold_metrics(spark, d, steps), *_FIVE, digits=5)

    @query(f"sweep_curve{suffix}", sql(swept + f" SELECT threshold, {_R} FROM cv"))
    def _(spark, d):
        return rounded(sweep.curve(_fold_metrics(spark, d, steps)), *_FIVE, digits=5)

    @query(f"best_threshold{suffix}", sql(swept + f" SELECT threshold, {_R} FROM cv ORDER BY fscore DESC, threshold LIMIT 1"))
    def _(spark, d):
        return rounded(sweep.best_threshold(sweep.curve(_fold_metrics(spark, d, steps))), *_FIVE, digits=5)

    @query(f"nearest_threshold{suffix}", sql(swept + f" SELECT threshold, {_R} FROM cv ORDER BY abs(threshold - 0.5), threshold LIMIT 1"))
    def _(spark, d):
        return rounded(sweep.nearest_threshold(sweep.curve(_fold_metrics(spark, d, steps)), 0.5), *_FIVE, digits=5)

    @query(f"test_at_selected_threshold{suffix}", sql(swept + f", v AS (SELECT threshold FROM (SELECT threshold, avg(fscore) AS f FROM fm WHERE fold < 3 GROUP BY threshold) ORDER BY f DESC, threshold LIMIT 1) SELECT threshold, fold, {_R} FROM fm JOIN v USING (threshold) WHERE fold >= 3"))
    def _(spark, d):
        own = _fold_metrics(spark, d, steps)
        best = sweep.best_threshold(sweep.curve(own.filter("fold < 3")))
        return rounded(sweep.apply_selected(best, own.filter("fold >= 3")), *_FIVE, digits=5)

    @query(f"sweep_summary{suffix}", sql(swept + " SELECT threshold, " + ", ".join(f"round(avg({c}), 5) AS {c}_mean, round(stddev_samp({c}), 5) AS {c}_std" for c in _FIVE) + " FROM fm GROUP BY threshold"))
    def _(spark, d):
        own = sweep.summary(_fold_metrics(spark, d, steps), ("threshold",))
        return rounded(own, *[c for c in own.columns if c != "threshold"], digits=5)


#: The SQL of the names without a suffix is fixed to four steps; _full has the reference's grid.
_sweep_queries("", STEPS)
_sweep_queries("_full", sweep.VALIDATION)


# Reports and statistics


def _metrics_table(spark, d):
    """Made per-image metrics: images appear in two folds each."""
    own = X.images(spark, d).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "*")
    return own.selectExpr(
        "file_name AS image_name", "CAST((fold + k) % 5 AS INT) AS fold", "CASE WHEN image_id % 7 < 4 THEN 'train' WHEN image_id % 7 < 5 THEN 'val' ELSE 'test' END AS split", "width", "height",
        "12 + k AS tiles_generated", "(image_id % 100) / 10.0D + k AS slicing_time_ms", "image_id % 30 AS annotations_original", "image_id % 30 - image_id % 5 AS annotations_kept", "least(image_id % 5, image_id % 30) AS annotations_discarded",
        "image_id % 3 AS empty_tiles_kept", "image_id % 2 AS empty_tiles_discarded",
    )


_M = """, mtr AS (SELECT file_name AS image_name, CAST((fold + k) % 5 AS INT) AS fold, CASE WHEN image_id % 7 < 4 THEN 'train' WHEN image_id % 7 < 5 THEN 'val' ELSE 'test' END AS split, width, height, 12 + k AS tiles_generated, (image_id % 100) / 10.0::DOUBLE + k AS slicing_time_ms,
  image_id % 30 AS annotations_original, least(image_id % 5, image_id % 30) AS annotations_discarded, image_id % 3 AS empty_tiles_kept, image_id % 2 AS empty_tiles_discarded FROM img, (SELECT unnest([0, 1]) AS k)),
fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_name ORDER BY fold) AS n FROM mtr) WHERE n = 1)"""


@query("first_seen_metrics", sql(_M + " SELECT image_name, fold, tiles_generated, round(slicing_time_ms, 6) AS slicing_time_ms FROM fs"))
def _(spark, d):
    return rounded(reports.first_seen(_metrics_table(spark, d)).select("image_name", "fold", "tiles_generated", "slicing_time_ms"), "slicing_time_ms")


@query("fold_summary", sql(_M + " SELECT fold, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val, count(*) FILTER (WHERE split = 'test') AS n_test, CAST(sum(tiles_generated) AS BIGINT) AS tiles, CAST(sum(annotations_discarded) AS BIGINT) AS annotations_discarded, round(avg(slicing_time_ms), 6) AS mean_slicing_time_ms FROM mtr GROUP BY fold"))
def _(spark, d):
    return rounded(reports.fold_summary(_metrics_table(spark, d)), "mean_slicing_time_ms")


@query("summary_report", sql(_M + """, u AS (SELECT count(*) AS original_images, CAST(sum(annotations_original) AS BIGINT) AS original_annotations, CAST(sum(annotations_discarded) AS BIGINT) AS discarded, CAST(sum(empty_tiles_kept) AS BIGINT) AS empty_tiles_kept, CAST(sum(empty_tiles_discarded) AS BIGINT) AS empty_tiles_discarded,
  round(avg(slicing_time_ms), 6) AS mean_time_ms, round(stddev_pop(slicing_time_ms), 6) AS std_time_ms FROM fs), a AS (SELECT CAST(sum(tiles_generated) AS BIGINT) AS tiles_all_folds FROM mtr)
SELECT *, round(tiles_all_folds / original_images, 6) AS mean_tiles_per_image, round(discarded / original_annotations * 100, 6) AS discard_rate_pct, original_annotations - discarded AS kept_annotations FROM u, a"""))
def _(spark, d):
    return rounded(reports.run_summary(_metrics_table(spark, d)), "mean_time_ms", "std_time_ms", "mean_tiles_per_image", "discard_rate_pct")


@query("resolution_groups", sql(tile_sql("asahi") + _M + ", one AS (SELECT width, height, min(image_id) AS i FROM img GROUP BY ALL), g AS (SELECT width, height, CAST(count(*) AS INT) AS tiles_per_image FROM tl WHERE image_id IN (SELECT i FROM one) GROUP BY ALL) SELECT fs.width || 'x' || fs.height AS resolution, count(*) AS image_count, max(tiles_per_image) AS tiles_per_image FROM fs JOIN g ON fs.width = g.width AND fs.height = g.height GROUP BY 1"))
def _(spark, d):
    return reports.resolution_groups(_metrics_table(spark, d), TILINGS["asahi"]).select("resolution", "image_count", "tiles_per_image")


@query("slicing_times", sql(_M + " SELECT fold, round(avg(slicing_time_ms), 4) AS slicing_time_ms_mean, round(sum(slicing_time_ms), 4) AS slicing_time_ms_total FROM mtr WHERE split = 'test' GROUP BY fold"))
def _(spark, d):
    return rounded(reports.slicing_times(_metrics_table(spark, d)), "slicing_time_ms_mean", "slicing_time_ms_total", digits=4)


@query("disk_estimate", sql(tile_sql("asahi") + f", n AS (SELECT image_id, count(*) + 1 AS n FROM tl GROUP BY ALL) SELECT round((sum(n) * (4 * CAST(0.85 AS DOUBLE)) * {int(640 * 640 * 3 * 0.08) + 512} + 1000000 * (1 + 4 * CAST(0.15 AS DOUBLE))) / 1e9, 6) AS gigabytes FROM n"))
def _(spark, d):
    own = tiling.resolution_histogram(X.images(spark, d))
    return rounded(reports.disk_estimate(own, TILINGS["asahi"], 5, 0.15, source_bytes=1_000_000), "gigabytes")


@query("tile_totals", sql(tile_sql("sahi") + " SELECT image_id, count(*) AS n_tiles, CAST(sum(tile_width * tile_height) AS BIGINT) AS tile_pixels FROM tl GROUP BY ALL"))
def _(spark, d):
    return reports.tile_totals(_tiled(spark, d, "sahi"))


@query("rebuilt_counts", sql(tile_sql("asahi") + _KEPT + ", t AS (SELECT image_id, count(*) AS tiles FROM tl GROUP BY ALL), k AS (SELECT image_id, count(*) AS n FROM kept GROUP BY ALL) SELECT 'img_' || image_id AS stem, tiles, CAST(coalesce(n, 0) AS BIGINT) AS annotations_kept FROM t LEFT JOIN k USING (image_id)"))
def _(spark, d):
    tiled = tiling.tile_names(tiling.tiles(X.images(spark, d), TILINGS["asahi"]))
    kept = labels.letterbox_labels(_kept(spark, d, "asahi")).withColumn("cls", F.col("category_id") - 1)
    lines = labels.label_lines(kept, ("image_id", "row_index", "column_index"), "ann_id")
    own = tiled.join(lines, ["image_id", "row_index", "column_index"], "left").select(F.col("tile_file").alias("sample_name"), "text")
    return reports.rebuilt_counts(own)


def _results(spark, d):
    own = X.annotations(spark, d)
    return own.selectExpr("concat('model_', ann_id % 3) AS model", "CAST(fold AS INT) AS fold", "(w % 97 + ann_id % 3) / 10.0D AS map50", "(h % 89) / 7.0D AS recall")


_L = ", lg AS (SELECT 'model_' || ann_id % 3 AS model, 'map50' AS metric, (w % 97 + ann_id % 3) / 10.0::DOUBLE AS value FROM ann UNION ALL SELECT 'model_' || ann_id % 3, 'recall', (h % 89) / 7.0::DOUBLE FROM ann), lgf AS (SELECT CAST(fold AS INT) AS fold, 'model_' || ann_id % 3 AS model, 'map50' AS metric, (w % 97 + ann_id % 3) / 10.0::DOUBLE AS value FROM ann UNION ALL SELECT CAST(fold AS INT), 'model_' || ann_id % 3, 'recall', (h % 89) / 7.0::DOUBLE FROM ann)"


@query("boxplot_stats", sql(_L + " SELECT model, metric, round(min(value), 6) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS high FROM lg GROUP BY ALL"))
def _(spark, d):
    return rounded(stats.box_numbers(stats.long_form(_results(spark, d), ["map50", "recall"])), "low", "q1", "median", "q3", "high")


@query("place_quantiles", sql(" SELECT fold, label, count(*) AS n, round(quantile_cont(x1, 0.1), 9) AS q0, round(quantile_cont(x1, 0.5), 9) AS q1, round(quantile_cont(x1, 0.99), 9) AS q2, round(max(x1), 9) AS high FROM det GROUP BY ALL"))
def _(spark, d):
    """Places of boxes: whole groups of tens of thousands, selected by histograms."""
    return rounded(stats.quantiles(X.detections(spark, d), "x1", [0.1, 0.5, 0.99], ("fold", "label")).select("fold", "label", "n", "q0", "q1", "q2", "high"), "q0", "q1", "q2", "high", digits=9)


@query("anova_f", sql(_L + ", g AS (SELECT metric, model, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM lg GROUP BY ALL), t AS (SELECT metric, sum(n) AS a, count(*) AS k, sum(n * m) AS s, sum(n * m * m) AS q, sum(n * v) AS w FROM g GROUP BY ALL) SELECT metric, round(((q - s * s / a) / (k - 1)) / (w / (a - k)), 5) AS f, k - 1 AS df_between, CAST(a - k AS BIGINT) AS df_within FROM t"))
def _(spark, d):
    return rounded(stats.anova(stats.long_form(_results(spark, d), ["map50", "recall"])), "f", digits=5)


_NODES = ", nd(x, w) AS (VALUES " + ", ".join(f"({x!r}::DOUBLE, {w!r}::DOUBLE)" for x, w in stats.nodes()) + ")"


@query("anova_p", sql(_L + _NODES + """, g AS (SELECT metric, fold, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM lgf GROUP BY ALL),
t AS (SELECT metric, sum(n) AS a, count(*) AS k, sum(n * m) AS s, sum(n * m * m) AS q, sum(n * v) AS w FROM g GROUP BY ALL),
f AS (SELECT metric, ((q - s * s / a) / (k - 1)) / (w / (a - k)) AS f, CAST(k - 1 AS DOUBLE) AS d1, CAST(a - k AS DOUBLE) AS d2 FROM t),
c AS (SELECT *, atan2(sqrt(d1 - 1), sqrt(d2 - 1)) AS top, 9 / sqrt(d1 + d2 - 2) AS far, atan2(sqrt(f * d1), sqrt(d2)) AS start FROM f),
e AS (SELECT *, greatest(top - far, 0.0) AS l0, least(top + far, pi() / 2) AS h0, greatest(start, top - far, 0.0) AS l1, least(greatest(start, top) + far, pi() / 2) AS h1 FROM c),
b AS (SELECT *, l0 + (h0 - l0) * x AS u0, l1 + (h1 - l1) * x AS u1 FROM e, nd)
SELECT metric, round(f, 5) AS f, round(sum(w * (h1 - l1) * exp((d2 - 1) * ln(cos(u1) / cos(top)) + (d1 - 1) * ln(sin(u1) / sin(top)))) / sum(w * (h0 - l0) * exp((d2 - 1) * ln(cos(u0) / cos(top)) + (d1 - 1) * ln(sin(u0) / sin(top)))), 6) AS p FROM b GROUP BY metric, f"""))
def _(spark, d):
    return rounded(rounded(stats.significance(stats.anova(stats.long_form(_results(spark, d), ["map50", "recall"]), "fold")), "f", digits=5), "p").select("metric", "f", "p")


def _pairs_sql(by: str) -> str:
    """Common table expressions g (groups), t (metrics) and tk (pairs with difference, q, p) of the results by a column."""
    return _NODES + f""", g AS (SELECT metric, {by} AS by_, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM lgf GROUP BY ALL),
t AS (SELECT metric, count(*) AS k, CAST(sum(n) - count(*) AS DOUBLE) AS df, sum(n * v) / (sum(n) - count(*)) AS spread, 9 / sqrt(2.0 * (sum(n) - count(*))) AS wide FROM g GROUP BY metric),
pr AS (SELECT t.*, a.by_ AS a, b.by_ AS b, b.m - a.m AS difference, abs(b.m - a.m) / sqrt(spread / 2 * (1.0 / a.n + 1.0 / b.n)) AS q, greatest(1 - wide, 0.0) AS lo FROM g a JOIN g b ON a.metric = b.metric AND a.by_ < b.by_ JOIN t ON t.metric = a.metric),
gr AS (SELECT pr.*, lo + (1 + wide - lo) * s.x AS pt, s.w * z.w AS ww, 16 * z.x - 8 AS top FROM pr, nd s, nd z),
gl AS (SELECT *, greatest(top - q * pt, -9.0) AS low FROM gr),
gu AS (SELECT metric, a, b, difference, q, k, df, pt, ww, top, sum((top - low) * u.w * exp(-pow(low + (top - low) * u.x, 2) / 2) / sqrt(2 * pi())) AS mid FROM gl, nd u GROUP BY ALL),
tk AS (SELECT metric, a, b, difference, q, greatest(least(1 - sum(ww * exp((df - 1) * ln(pt) - df * (pt * pt - 1) / 2) * 16 * k * exp(-top * top / 2) / sqrt(2 * pi()) * pow(mid, k - 1)) / sum(ww * exp((df - 1) * ln(pt) - df * (pt * pt - 1) / 2)), 1.0), 0.0) AS p FROM gu GROUP BY ALL)"""


@query("tukey_pairs", sql(_L + _pairs_sql("model") + " SELECT metric, a, b, round(difference, 6) AS difference, round(q, 5) AS q, round(p, 6) AS p FROM tk"))
def _(spark, d):
    """Pairs of models by the studentised range, over all rows of both metrics."""
    return rounded(rounded(stats.tukey(stats.long_form(_results(spark, d), ["map50", "recall"])), "difference", "p"), "q", digits=5)


@query("group_letters", sql(_L + _pairs_sql("model || fold % 2") + """, r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY m DESC, by_) - 1 AS i FROM g),
un AS (SELECT tk.metric, x.i AS i, y.i AS j FROM tk JOIN r x ON x.metric = tk.metric AND x.by_ = a JOIN r y ON y.metric = tk.metric AND y.by_ = b WHERE p < 0.05),
mk AS (SELECT metric, unnest(range(1, CAST(pow(2, k) AS BIGINT))) AS mask FROM t),
fr AS (SELECT * FROM mk WHERE NOT EXISTS (SELECT 1 FROM un WHERE un.metric = mk.metric AND (mask >> i) & 1 = 1 AND (mask >> j) & 1 = 1)),
mx AS (SELECT * FROM fr x WHERE NOT EXISTS (SELECT 1 FROM fr y WHERE y.metric = x.metric AND y.mask <> x.mask AND (y.mask & x.mask) = x.mask)),
nt AS (SELECT metric, mask, row_number() OVER (PARTITION BY metric ORDER BY list_filter(range(16), lambda b: (mask >> b) & 1 = 1)) AS nth FROM mx)
SELECT r.metric, by_ AS name, round(m, 6) AS mean, string_agg(chr(CAST(96 + nth AS INT)), '' ORDER BY nth) AS letters FROM r JOIN nt ON nt.metric = r.metric AND (mask >> i) & 1 = 1 GROUP BY r.metric, by_, m"""))
def _(spark, d):
    """Compact letters of six groups of each metric; the SQL enumerates all sets of groups without a difference."""
    own = stats.long_form(_results(spark, d), ["map50", "recall"]).withColumn("name", F.concat("model", (F.col("fold") % 2).cast("string")))
    return rounded(stats.lettered(own, "name"), "mean")


@query("linear_fit", sql(ROWS + " SELECT fold, round(regr_slope(predicted, groundtruth), 6) AS slope, round(regr_intercept(predicted, groundtruth), 5) AS intercept FROM counts GROUP BY fold"))
def _(spark, d):
    own = _rows(spark, d).join(X.images(spark, d).select("image_id", "fold"), "image_id")
    return rounded(rounded(stats.linear_fit(own, ("fold",)), "slope"), "intercept", digits=5)


@query("union_results", sql(_L + " SELECT model, metric, count(*) AS n FROM (SELECT * FROM lg UNION ALL SELECT 'baseline', metric, value FROM lg) GROUP BY ALL"))
def _(spark, d):
    own = stats.long_form(_results(spark, d), ["map50", "recall"])
    return stats.unioned(own, own.withColumn("model", F.lit("baseline"))).groupBy("model", "metric").agg(F.count(F.lit(1)).alias("n"))


# Compositions

EVAL = NMS + f""", fin AS (SELECT det.* FROM det JOIN nms USING (det_id)),
pr AS (SELECT o.image_id, o.fold, o.det_id, o.score, gt.gt_id, {iou_of('o', 'gt')} AS iou FROM fin o JOIN gt ON o.image_id = gt.image_id AND o.x1 < gt.x2 AND gt.x1 < o.x2 AND o.y1 < gt.y2 AND gt.y1 < o.y2),
br AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, gt_id) AS n FROM pr),
mt AS (SELECT o.image_id, o.fold, o.det_id, o.score, br.gt_id, coalesce(br.iou >= 0.5, FALSE) AS near FROM fin o LEFT JOIN br ON o.det_id = br.det_id AND br.n = 1),
matches AS (SELECT *, near AND row_number() OVER (PARTITION BY image_id, gt_id, near ORDER BY score DESC, det_id) = 1 AS is_tp FROM mt),
cr AS (SELECT img.image_id, img.fold, coalesce(g, 0) AS groundtruth, coalesce(w, 0) AS raw_predicted, coalesce(p, 0) AS predicted, coalesce(t, 0) AS tp FROM img LEFT JOIN (SELECT image_id, count(*) AS g FROM gt GROUP BY ALL) USING (image_id)
  LEFT JOIN (SELECT image_id, count(*) AS w FROM det GROUP BY ALL) USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS p, count(*) FILTER (WHERE is_tp) AS t FROM matches GROUP BY ALL) USING (image_id)),
counts AS (SELECT *, raw_predicted - predicted AS removed_by_suppression, predicted - tp AS fp, groundtruth - tp AS fn FROM cr)"""


def _evaluated(spark, d):
    from ..operators.evaluation import evaluate

    return evaluate(X.images(spark, d), X.truths(spark, d), X.detections(spark, d))


@query("evaluation_counting", sql(EVAL + " SELECT fold, image_id, groundtruth, raw_predicted, predicted, removed_by_suppression, tp, fp, fn FROM counts"))
def _(spark, d):
    return _evaluated(spark, d)[1]


@query("evaluation_results", sql(EVAL + """, s AS (SELECT fold, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(abs(predicted - groundtruth)) AS mae, sqrt(avg((predicted - groundtruth) * (predicted - groundtruth))) AS rmse FROM counts GROUP BY ALL),
q AS (SELECT *, tp / (tp + fp + 1e-9) AS precision, tp / (tp + fn + 1e-9) AS recall FROM s)
SELECT fold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall + 1e-9), 6) AS fscore, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM q"""))
def _(spark, d):
    return rounded(_evaluated(spark, d)[0].select("fold", "precision", "recall", "fscore", "mae", "rmse"), "precision", "recall", "fscore", "mae", "rmse")


@query("suppression_summary", sql(NMS + """, f AS (SELECT image_id, count(*) AS final_count, min(score) AS a, max(score) AS b, avg(score) AS m FROM det JOIN nms USING (det_id) GROUP BY ALL), r AS (SELECT image_id, count(*) AS raw_count FROM det GROUP BY ALL)
SELECT img.image_id, coalesce(raw_count, 0) AS raw_count, coalesce(final_count, 0) AS final_count, round(a, 3) AS score_min, round(b, 3) AS score_max, coalesce(raw_count, 0) - coalesce(final_count, 0) AS duplicates_removed FROM img LEFT JOIN f USING (image_id) LEFT JOIN r USING (image_id)"""))
def _(spark, d):
    own = X.detections(spark, d)
    return inference.summary(X.images(spark, d), own, suppression.nms(own)).drop("score_mean")


@query("threshold_grid", sql(f", st AS (SELECT unnest({sweep.VALIDATION}::DOUBLE[]) AS threshold) SELECT threshold, fold, count(*) AS n FROM det JOIN st ON score >= threshold GROUP BY ALL"))
def _(spark, d):
    return X.detections(spark, d).select("fold", sweep._reached(sweep.VALIDATION)).groupBy("threshold", "fold").agg(F.count(F.lit(1)).alias("n"))


def _dashboard_queries(suffix: str, steps: list[float], cube_steps: list[float]) -> None:
    @query(f"scatter_counts{suffix}", sql(NMS + f", st AS (SELECT unnest({steps}::DOUBLE[]) AS threshold), k AS (SELECT image_id, threshold, count(*) AS n FROM det JOIN nms USING (det_id) JOIN st ON score >= threshold GROUP BY ALL), g AS (SELECT image_id, count(*) AS gt FROM gt GROUP BY ALL) SELECT img.fold, img.image_id, coalesce(gt, 0) AS gt, st.threshold, coalesce(n, 0) AS n FROM img CROSS JOIN st LEFT JOIN g USING (image_id) LEFT JOIN k ON k.image_id = img.image_id AND k.threshold = st.threshold"))
    def _(spark, d):
        kept = sweep.at_thresholds(X.detections(spark, d), steps, keys=("fold", "image_id"))
        own = sweep.scatter(X.images(spark, d), kept, X.truths(spark, d), steps)
        return own.select("fold", "image_id", "gt", F.explode("pred").alias("threshold", "n"))

    @query(f"threshold_cube{suffix}")
    def _(spark, d):
        return sweep.cube(_fold_metrics(spark, d, cube_steps).withColumn("arch", F.lit("made")), ("arch",))


_dashboard_queries("", STEPS, STEPS)
_dashboard_queries("_full", sweep.SCATTER, sweep.CUBE)


@query("letterbox_params", sql(", r AS (SELECT DISTINCT width, height FROM img), s AS (SELECT *, least(640.0::DOUBLE / width, 640.0::DOUBLE / height) AS scale FROM r) SELECT width, height, CAST(floor((640 - CAST(trunc(width * scale) AS INT)) / 2.0) AS INT) AS pad_x, CAST(floor((640 - CAST(trunc(height * scale) AS INT)) / 2.0) AS INT) AS pad_y FROM s"))
def _(spark, d):
    box = tiling.letterbox(F.col("width"), F.col("height"))
    return X.images(spark, d).select("width", "height").distinct().select("width", "height", box["pad_x"].alias("pad_x"), box["pad_y"].alias("pad_y"))


@query("overlap_metadata", sql(tile_sql("sahi") + " SELECT image_id, x, y, 640 AS tile_side, 96 AS overlap_x, 96 AS overlap_y FROM tl"))
def _(spark, d):
    own = tiling.overlap_metadata(_tiled(spark, d, "sahi"), TILINGS["sahi"])
    return own.select("image_id", "x", "y", F.col("tile_size")[0].alias("tile_side"), F.col("overlap_px")[0].alias("overlap_x"), F.col("overlap_px")[1].alias("overlap_y"))


@query("parsed_labels", sql("SELECT 'img_' || image_id AS sample_name, CAST(sum(category_id - 1) AS BIGINT) AS classes, count(*) AS n, CAST(sum(w) AS BIGINT) AS total FROM ann GROUP BY ALL"))
def _(spark, d):
    from ..sources.readers import parsed_labels

    one = F.struct("ann_id", F.concat_ws(" ", (F.col("category_id") - 1).cast("string"), *[F.col(c).cast("string") for c in ("x", "y", "w", "h")]).alias("line"))
    lines = X.annotations(spark, d).groupBy(F.concat(F.lit("img_"), F.col("image_id").cast("string")).alias("sample_name")).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(one)), lambda s: s["line"]), F.lit("short 1 2")).alias("text"))
    return parsed_labels(lines).groupBy("sample_name").agg(F.sum("cls").alias("classes"), F.count(F.lit(1)).alias("n"), F.sum("w").cast("long").alias("total"))


@query("fold_members", sql(tile_sql("sahi") + " SELECT DISTINCT CAST(fold AS INT) AS split_fold, 'train' AS split, 'img_' || image_id AS stem FROM tl"))
def _(spark, d):
    own = tiling.tile_names(tiling.tiles(X.images(spark, d), TILINGS["sahi"]))
    return labels.fold_members(own.select(F.col("fold").cast("int").alias("split_fold"), F.lit("train").alias("split"), F.col("tile_file").alias("sample_name")))

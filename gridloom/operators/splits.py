"""Train, validation and test splits of images.

Two modes: by hash (any scale: a rank by an arithmetic hash of the id, no driver state), and compatible with numpy's generator (positions shuffled on
the driver, for sets of images that a driver holds). Ranks need a total order; to number an image set of any size in parallel they come from
hash ranges, each a window of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import prefix

RANGES = 64
#: Steps of a walk back into the places of a permutation; each ends it with a chance of a quarter at least.
WALK = 256


def mixed(id_: Column, seed: int = 0) -> Column:
    """A 32-bit hash that SQL engines share."""
    return F.pmod((id_ + seed) * F.lit(2654435761), F.lit(4294967296))


def numbered(df: DataFrame, id_col: str, seed: int = 0, keys: tuple[str, ...] = (), then: tuple[str, ...] = ()) -> DataFrame:
    """df with pos (0, 1, ...) by the hash of id_col, then the id (and what else is named), and n, the number of rows, both within keys."""
    h = mixed(F.col(id_col), seed)
    rows = df.withColumns({"_h": h, "_range": F.floor(h / (4294967296 // RANGES)).cast("int")})
    totals = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(*keys)).alias("n"))
    inside = F.row_number().over(W.partitionBy(*keys, "_range").orderBy("_h", id_col, *then))
    rows = rows.withColumn("_at", inside).join(totals, [*keys, "_range"])
    return rows.withColumn("pos", F.col("_at") - 1 + F.col("_before")).drop("_h", "_range", "_at", "_before")


def kfold_holdout(images: DataFrame, folds: int = 5, val_ratio: float = 0.15, seed: int = 42, id_col: str = "image_id") -> DataFrame:
    """images for each fold with split. The first n % folds chunks have one more image; chunk i is fold i's test set, and of the
    others, in order, the first max(1, round half even of their share) are its validation set."""
    return _chunked(numbered(images, id_col, seed), folds, val_ratio)


def _chunked(rows: DataFrame, folds: int, val_ratio: float) -> DataFrame:
    """rows with pos and n for each fold with split, as kfold_holdout says."""
    size, more = F.floor(F.col("n") / folds), F.col("n") % folds
    chunk = F.when(F.col("pos") < more * (size + 1), F.floor(F.col("pos") / (size + 1))).otherwise(more + F.floor((F.col("pos") - more * (size + 1)) / F.greatest(size, F.lit(1))))
    rows = rows.withColumn("chunk", chunk.cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("split_fold"))
    test = size + (F.col("split_fold") < more).cast("long")
    n_val = F.greatest(F.lit(1), F.bround((F.col("n") - test) * val_ratio).cast("long"))
    in_pool = F.when(F.col("chunk") < F.col("split_fold"), F.col("pos")).otherwise(F.col("pos") - test)
    split = F.when(F.col("chunk") == F.col("split_fold"), "test").when(in_pool < n_val, "val").otherwise("train")
    return rows.withColumn("split", split).drop("pos", "n", "chunk")


def permuted(place: Column, n: int, key: int = 0) -> Column:
    """Where a keyed permutation of 0 to n - 1 sends a place: a Feistel network on the least even number of bits that n fits in, applied again as long as it
    leads beyond n. Each row works out its own, so nothing is sorted; the number of places beyond n is under 3 n, so a walk of WALK steps that does not end is out of reach."""
    half = next(h for h in range(1, 32) if 4**h >= n)
    mask, keys = (1 << half) - 1, F.array(*[F.lit(k).cast("long") for k in round_keys(key)])

    def once(x: Column) -> Column:
        def swap(a: Column, k: Column) -> Column:
            right = a.bitwiseAND(F.lit(mask))
            mixed_ = F.shiftright(((right + k) * F.lit(2654435761)) % F.lit(4294967296), 8)
            return right * F.lit(1 << half) + F.shiftright(a, half).bitwiseXOR(mixed_.bitwiseAND(F.lit(mask)))

        return F.aggregate(keys, x, swap)

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(place.cast("long")), lambda x, _: F.when(x < n, x).otherwise(once(x)))


def round_keys(key: int) -> list[int]:
    return [(key * 7919 + i * 104729) % (1 << 31) for i in range(1, 5)]


def kfold_permuted(images: DataFrame, folds: int = 5, val_ratio: float = 0.15, key: int = 42, id_col: str = "image_id") -> DataFrame:
    """As kfold_holdout, with images in the order of a keyed permutation of their numbers by id: numbered once, they are dealt anew with any key without a sort."""
    rows = prefix.numbered(images, [id_col], "_n")
    total = rows.count()
    return _chunked(rows.select(*images.columns, permuted(F.col("_n") - 1, total, key).alias("pos"), F.lit(total).cast("long").alias("n")), folds, val_ratio)


def fixed_ratios(images: DataFrame, folds: int = 5, val_ratio: float = 0.15, test_ratio: float = 0.2, seed: int = 42, id_col: str = "image_id") -> DataFrame:
    """images for each fold with split, reshuffled for each fold: first the test set, then validation, the rest trains."""
    rows = images.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("split_fold"))
    rows = numbered(rows.withColumn("_id", F.col(id_col) + F.col("split_fold") * 7919), "_id", seed, ("split_fold",))
    share = lambda r: F.greatest(F.lit(1), F.bround(F.col("n") * r).cast("long"))
    split = F.when(F.col("pos") < share(test_ratio), "test").when(F.col("pos") < share(test_ratio) + share(val_ratio), "val").otherwise("train")
    return rows.withColumn("split", split).drop("pos", "n", "_id")


def grouped_ratios(images: DataFrame, group_col: str, folds: int = 5, val_ratio: float = 0.15, test_ratio: float = 0.2, seed: int = 42, id_col: str = "image_id") -> DataFrame:
    """As fixed_ratios, but whole groups are shuffled (by their smallest id), and cut by the number of images, so that a group may lie in two splits."""
    first = images.groupBy(group_col).agg(F.min(id_col).alias("_first"))
    rows = images.join(first, group_col).select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("split_fold"))
    rows = numbered(rows.withColumn("_id", F.col("_first") + F.col("split_fold") * 7919), "_id", seed, ("split_fold",), (id_col,))
    share = lambda r: F.greatest(F.lit(1), F.bround(F.col("n") * r).cast("long"))
    split = F.when(F.col("pos") < share(test_ratio), "test").when(F.col("pos") < share(test_ratio) + share(val_ratio), "val").otherwise("train")
    return rows.withColumn("split", split).drop("pos", "n", "_id", "_first")


def sizes_fit(n: int, val_ratio: float, test_ratio: float) -> None:
    """Raises ValueError where validation and test would leave nothing to train on."""
    if max(1, round(n * test_ratio)) + max(1, round(n * val_ratio)) >= n:
        raise ValueError(f"{n} images are too few for these ratios")


def permutation(n: int, seed: int) -> np.ndarray:
    """Positions in the order of numpy's default generator."""
    out = np.arange(n)
    np.random.default_rng(seed).shuffle(out)
    return out


def _pool_split(images: list, test: list[int], pool: list[int], val_ratio: float) -> dict[str, list]:
    n_val = max(1, round(len(pool) * val_ratio))
    return {"train": [images[i] for i in pool[n_val:]], "val": [images[i] for i in pool[:n_val]], "test": [images[i] for i in test]}


def compatible_kfold(images: list, folds: int, val_ratio: float, seed: int) -> list[dict[str, list]]:
    """As kfold_holdout over a driver's list, in numpy's order."""
    chunks = np.array_split(permutation(len(images), seed), folds)
    return [_pool_split(images, chunks[f].tolist(), [i for g in range(folds) if g != f for i in chunks[g].tolist()], val_ratio) for f in range(folds)]


def compatible_ratios(images: list, folds: int, val_ratio: float, test_ratio: float, seed: int, groups: dict | None = None) -> list[dict[str, list]]:
    """As fixed_ratios over a driver's list, in numpy's order; groups (name to group) are shuffled whole but may be cut at a split's end."""
    n = len(images)
    sizes_fit(n, val_ratio, test_ratio)
    n_test, n_val, out = max(1, round(n * test_ratio)), max(1, round(n * val_ratio)), []
    for f in range(folds):
        if groups is None:
            order = permutation(n, seed + f).tolist()
        else:
            members: dict = {}
            for i, name in enumerate(images):
                members.setdefault(groups.get(name, name), []).append(i)
            names = list(members)
            np.random.default_rng(seed + f).shuffle(names)
            order = [i for g in names for i in members[g]]
        pick = [images[i] for i in order]
        out.append({"test": pick[:n_test], "val": pick[n_test : n_test + n_val], "train": pick[n_test + n_val :]})
    return out


def group_folds(sizes: dict, folds: int) -> dict:
    """Group to fold: the largest group first (stable), always into the emptiest fold (the first of equals)."""
    load, out = [0] * folds, {}
    for g in sorted(sizes, key=lambda g: -sizes[g]):
        out[g] = load.index(min(load))
        load[out[g]] += sizes[g]
    return out


def shares(load: list[int], size: int, count: int) -> list[int]:
    """How many of `count` groups of this size each fold gets when each goes to the emptiest fold (the first of equals). A fold offers its places at loads that are a
    size apart, and the lowest places are taken; the last load among them comes from a binary search, so the count does not matter."""
    below = lambda x: sum(max(0, -((n - x) // size)) for n in load)  # noqa: E731  places under a load of x
    low, high = min(load), min(load) + count * size
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if below(middle) <= count else (low, middle - 1)
    out, rest = [max(0, -((n - low) // size)) for n in load], count - below(low)
    for f, n in enumerate(load):
        if rest and n <= low and not (low - n) % size:
            out[f], rest = out[f] + 1, rest - 1
    return out


def group_kfold(images: DataFrame, group_col: str, folds: int = 5) -> DataFrame:
    """images with test_fold, by group_folds (groups of equal size in their order), for any number of groups: the driver sees only how many groups have each size.

    Of the groups of a size each has a rank, and the places that folds offer for that size have theirs, by load and then fold, worked out from the loads before;
    the two meet in a join. Null is a group.
    """
    sizes = images.groupBy(group_col).agg(F.count(F.lit(1)).alias("_n"))
    ranked = prefix.running(sizes, [group_col], {"_rank": F.lit(1)}, ("_n",))
    load, rows = [0] * folds, []
    for size, count in sorted(map(tuple, ranked.groupBy("_n").count().collect()), reverse=True):
        own = shares(load, size, count)
        rows += [(size, f, list(load), n) for f, n in enumerate(own) if n]
        load = [x + n * size for x, n in zip(load, own, strict=True)]
    places = images.sparkSession.createDataFrame(rows, "_n long, test_fold int, _load array<long>, _taken int")
    places = places.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_taken") - 1)))
    at, n, fold = F.element_at("_load", F.col("test_fold") + 1) + F.col("_at") * F.col("_n"), F.col("_n"), F.col("test_fold")
    before = F.transform("_load", lambda x, g: F.when(at > x, F.ceil((at - x) / n)).otherwise(0) + F.when((g < fold) & (at >= x) & ((at - x) % n == 0), 1).otherwise(0))
    places = places.select("_n", "test_fold", (F.aggregate(before, F.lit(0).cast("long"), lambda a, x: a + x) + 1).alias("_rank"))
    placed = ranked.join(places, ["_n", "_rank"]).select(F.col(group_col).alias("_group"), "test_fold")
    return images.join(placed, F.col(group_col).eqNullSafe(F.col("_group"))).select(*images.columns, "test_fold")


def sample_empty(tiles: DataFrame, n_annotated: int, ratio: float, id_col: str, seed: int = 0) -> DataFrame:
    """Of empty tiles ceil(n_annotated * ratio), by hash; all if there are fewer."""
    want = int(np.ceil(n_annotated * ratio))
    return numbered(tiles, id_col, seed).filter(F.col("pos") < want).drop("pos", "n")


def audit(splits: DataFrame, val_ratio: float, test_ratio: float, tolerance: int = 1) -> DataFrame:
    """Folds and splits whose number of images is off the expected one by more than the tolerance."""
    n = splits.groupBy("split_fold").pivot("split", ["train", "val", "test"]).agg(F.count(F.lit(1))).fillna(0)
    total = F.col("train") + F.col("val") + F.col("test")
    val, test = F.bround(total * val_ratio).cast("long"), F.bround(total * test_ratio).cast("long")
    one = lambda name, n, expected: F.struct(F.lit(name).alias("split"), F.col(n).alias("n"), expected.alias("expected"))
    want = F.array(one("train", "train", total - val - test), one("val", "val", val), one("test", "test", test))
    return n.select("split_fold", F.inline(want)).filter(F.abs(F.col("n") - F.col("expected")) > tolerance)


def by_padded_stem(df: DataFrame, name: str = "file_name") -> DataFrame:
    """Sorted by the stem padded with zeros to 12 characters, then the name."""
    return df.orderBy(padded_stem(name), name)


def padded_stem(name: str = "file_name") -> Column:
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.when(F.length(stem) >= 12, stem).otherwise(F.lpad(stem, 12, "0"))


def random_image(images: DataFrame, seed: int | None = None) -> DataFrame:
    return images.orderBy(F.rand(seed)).limit(1)


def unfinished(folds: DataFrame, done: DataFrame) -> DataFrame:
    """Folds that have no written result yet."""
    return folds.join(done.select("fold").distinct(), "fold", "left_anti")

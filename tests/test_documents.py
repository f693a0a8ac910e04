import json
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import prefix
from gridloom.sources import documents, readers, writers


def document(seed, n=24):
    """Lists between other members, with braces, brackets, quotes and escapes in strings, nested objects, and members that are no lists of objects."""
    r = random.Random(seed)
    odd = lambda: r.choice(["a}b", '"{"', "\\", "}\\\"]", "[{", "plain", "é\n", ",\"annotations\":[{", ""])
    entry = lambda i: {"id": i, "name": odd(), "bbox": [1, 2, [3, {"x": odd()}]], "more": r.choice([None, {}, {"deep": {"er": [{"z": odd()}]}}])}
    return {"info": {"by": {"x": {"y": 1}}, "note": odd()}, "images": [entry(i) for i in range(n)], "plain": [1, [2], "x}"], "none": [], "licenses": [{}], "annotations": [entry(i) for i in range(n // 2)], "end": {"a": {}}}


@pytest.mark.parametrize(("seed", "indent", "split"), [(0, None, 150), (1, 2, 400), (3, 1, 1 << 20)])
def test_entries_of_a_split_document(spark, tmp_path, seed, indent, split):
    doc = document(seed)
    doc["images"][7]["name"] = "long }" * 100  # one entry over many splits
    (tmp_path / "_doc.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=seed % 2 == 0) + r"  "[: seed])
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        if split < 1000:
            assert spark.read.option("lineSep", "}").text(documents._visible(spark, f"{tmp_path}/_doc.json")).rdd.getNumPartitions() > 10
        folder = documents.sections(spark, f"{tmp_path}/_doc.json")
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    for name in doc:
        got = [json.loads(r.value) for r in spark.read.text(f"{folder}/section={name}").collect()] if readers.exists(spark, f"{folder}/section={name}") else []
        want = [e for e in doc[name] if isinstance(e, dict)] if isinstance(doc[name], list) else []
        assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, want)), name


def test_documents_of_a_folder(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"images": [{"id": 10 * i + k} for k in range(4)]}))
    folder = documents.sections(spark, str(tmp_path))
    assert sorted(r.id for r in spark.read.json(f"{folder}/section=images").collect()) == [10 * i + k for i in range(3) for k in range(4)]


def test_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(1000).select("id", F.concat(F.lit('x"{'), F.col("id").cast("string")).alias("file_name"))
    path = writers.write_coco_file(str(tmp_path), rows, rows.limit(0), rows.filter("id < 2"), fixed={"info": {"by": "é"}, "licenses": []}, tasks=7)
    doc = json.loads(open(path).read())
    assert list(doc) == ["info", "licenses", "images", "annotations", "categories"] and doc["info"] == {"by": "é"}
    assert doc["images"] == [{"id": i, "file_name": f'x"{{{i}'} for i in range(1000)] and doc["annotations"] == [] and len(doc["categories"]) == 2
    assert {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {readers.CLEAN}
    again = readers.coco(spark, str(tmp_path))
    assert sorted(r.id for r in again["images"].collect()) == list(range(1000)) and again["annotations"].count() == 0
    writers.write_coco_file(str(tmp_path), rows.limit(1), rows.limit(0), rows.limit(0))
    assert len(json.loads(open(path).read())["images"]) == 1


def test_numbers_and_running_sums(spark):
    r = random.Random(1)
    values = [(i, r.choice(["a", "a", "a", "b", None]), r.randrange(50), r.choice([None, 1, 2])) for i in range(2000)]
    df = spark.createDataFrame(values, "id long, g string, at int, v int")
    got = sorted(map(tuple, prefix.numbered(df, [F.desc("at"), "id"], tasks=9).collect()), key=lambda x: x[-1])
    assert [x[:4] for x in got] == sorted(values, key=lambda x: (-x[2], x[0])) and [x[4] for x in got] == list(range(1, 2001))
    want, sums = {}, {}
    for i, g, _, v in sorted(values, key=lambda x: (x[2], x[0])):
        n, s = sums.get(g, (0, 0))
        sums[g] = want[i] = (n + 1, s + (v or 0))
    rows = prefix.running(df, ["at", "id"], {"n": F.lit(1), "s": F.col("v")}, ("g",), tasks=9)
    assert {x.id: (x.n, x.s) for x in rows.collect()} == want
    whole = prefix.running(df, ["at", "id"], {"n": F.lit(1)}, tasks=5)
    assert sorted(x.n for x in whole.collect()) == list(range(1, 2001))
    assert prefix.running(df.limit(0), ["at"], {"n": F.lit(1)}, ("g",)).collect() == [] == prefix.numbered(df.limit(0), ["at"]).collect()


def test_only_chosen_files_are_copied(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("x.jpg", "y [1].jpg", "z{2}.jpg", "other.jpg"):
        (tmp_path / "a" / name).write_bytes(name.encode())
    names = spark.createDataFrame([("x.jpg",), ("y [1].jpg",), ("z{2}.jpg",), ("none.jpg",), ("x.jpg",)], "file_name string")
    for block in (1, 100):
        assert writers.copy_split(f"{tmp_path}/a", f"{tmp_path}/to{block}", names, block) == 3
        assert {p.name: p.read_bytes() for p in (tmp_path / f"to{block}").iterdir() if not p.name.startswith(".")} == {n: n.encode() for n in ("x.jpg", "y [1].jpg", "z{2}.jpg")}

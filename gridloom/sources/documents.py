"""One JSON object of any size, read by many tasks and written by many.

Reading: an object of lists, such as {"images": [{...}, ...], "annotations": [...]}, has no line that a reader could split at. The file is read in pieces that end
at a closing brace, by as many tasks as it has splits. A first pass works out for each split how it changes the state (inside a string or not, depth), for
both states it may begin in; a prefix scan over the splits, one row each, then gives every split's true start. The second pass cuts the entries of the lists out
of each split; one that spans splits is put together from its parts. The entries are written as JSON lines, a folder for each list, which Spark reads as any others.

Writing: each list is sorted by ranges of its order into part files of lines, which carry their separators, as each row knows its place. The parts are joined through the file system, as bytes,
and the whole is renamed; no row and no task holds the document.
"""

from __future__ import annotations

import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prefix import numbered
from .scratch import scratch

_ESCAPED = re.compile(r"\\.", re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}:]', re.S)
_CLOSED = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_NEXT = re.compile(r"[\s,]*(?=\{)")


def _visible(spark: SparkSession, path: str) -> str:
    """A path of the same file that Spark's readers list. They pass over names that begin with an underscore or a dot, so such a file gets a name in a view of its
    own of the file system; nothing is copied."""
    if not path.rsplit("/", 1)[-1].startswith(("_", ".")):
        return path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole, view = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString(), f"document-{uuid.uuid4().hex}"
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{view}.link./document.json", whole)
    return f"viewfs://{view}/document.json"


def step(piece: str, inside: int) -> tuple[int, int]:
    """(inside, change of depth) after a piece and the brace that ended it; inside: 1 in a string. What follows a document's last brace counts as ended by one
    too, which changes nothing, as no entry is open there."""
    parts = (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
    outside = parts[0] if len(parts) == 1 and not inside else "".join(parts[inside::2])
    after = (inside + len(parts) - 1) % 2
    return after, outside.count("{") + outside.count("[") - outside.count("]") - (not after)


def _heads(piece: str, depth: int, skip: int) -> tuple[tuple[str, str] | None, int | None]:
    """Of a piece that begins at this depth (2 or less), from a place outside strings on: the last (name, bracket) that leads from depth 1 to 2, and where an object at depth 2 begins."""
    head = key = text = None
    for m in _TOKEN.finditer(piece, skip):
        t = m[0]
        if t == ":":
            key = text if depth == 1 else key
        elif t == "]":
            depth -= 1
        elif t in "[{":
            if depth == 2 and t == "{":
                return head, m.start()
            depth += 1
            head = (json.loads(key or '""'), t) if depth == 2 else head
        else:
            text = t
    return head, None


def _splits(batches, run):
    """run(file, start) makes a consumer of the pieces of each split; what consumers yield for a piece, and at the end of their split."""
    here = consumer = None
    for batch in batches:
        names = batch.schema.names
        for text, file, start in zip(*(batch.column(names.index(c)).to_pylist() for c in ("value", "file", "start")), strict=True):
            if (file, start) != here:
                if consumer:
                    yield from consumer.done()
                here, consumer = (file, start), run(file, start)
            yield from consumer.take(text)
    if consumer:
        yield from consumer.done()


class _State:
    """A split's change of state for both states that it may begin in: parity of quotes, depth, least depth after a brace."""

    def __init__(self, file: str, start: int):
        self.at, self.inside, self.depth, self.least = (file, start), [0, 1], [0, 0], [1 << 30, 1 << 30]

    def take(self, piece: str):
        for k in (0, 1):
            self.inside[k], change = step(piece, self.inside[k])
            self.depth[k] += change
            self.least[k] = min(self.least[k], self.depth[k])
        return ()

    def done(self):
        yield (*self.at, self.inside[0], *self.depth, *self.least)


class _Entries:
    """Entries of a split from its true start: rows (group, part, entry, whole, list, bracket), where group and part name an entry that spans splits, and list is null
    as long as it is that of an earlier split; at the end the last list begun."""

    def __init__(self, file: str, start: int, begin: dict):
        self.file, self.start, (self.inside, self.depth, self.group) = file, start, begin[file, start]
        self.head, self.parts, self.tail = (None, None), [] if self.depth >= 3 else None, self.depth >= 3

    def take(self, piece: str):
        if self.depth <= 2:
            begun = _CLOSED.match(piece) if self.inside else None  # a string that an earlier piece began
            skip = begun.end() if begun else len(piece) * self.inside
            m = _NEXT.match(piece, skip) if self.depth == 2 else None
            head, at = (None, m.end()) if m else _heads(piece, self.depth, skip)
            self.head = head or self.head
            self.parts = None if at is None else []
            if at is not None:  # the piece is cut at the entry's brace, where the depth is 2
                piece, self.depth, self.inside = piece[at:], 2, 0
        self.inside, change = step(piece, self.inside)
        self.depth += change
        if self.parts is not None:
            self.parts.append(piece)
            if self.depth == 2 and not self.inside:
                yield self._row(not self.tail)
                self.parts, self.tail = None, False

    def _row(self, whole: bool):
        text = ("}".join(self.parts) + "}").replace("\n", " ").replace("\r", " ")
        return (self.file, self.start, None if whole else self.group if self.tail else self.start, text, *self.head, "entry")

    def done(self):
        if self.parts:
            yield self._row(False)
        yield (self.file, self.start, None, None, *self.head, "head")


def sections(spark: SparkSession, path: str) -> str:
    """A folder with the lists of a document (or of a folder's documents) as JSON lines, an entry each, below section=<name>; see the module. Entries are objects; what
    is no list of objects is left out, and a list without any has no folder. Names of lists have no closing brace."""
    raw = spark.read.option("lineSep", "}").text(_visible(spark, path))
    m = F.col("_metadata")
    pieces = raw.select("value", m["file_path"].alias("file"), m["file_block_start"].alias("start"))

    def rows(names, found):
        found = list(found)
        return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in found]) if found else None

    state = ["file", "start", "parity", "depth_0", "depth_1", "least_0", "least_1"]

    def scan(batches):
        if out := rows(state, _splits(batches, _State)):
            yield out

    changes = sorted(pieces.mapInArrow(scan, "file string, start long, parity long, depth_0 long, depth_1 long, least_0 long, least_1 long").collect())  # a row for each split
    begin, before = {}, None
    for file, start, parity, *change in changes:
        if file != before:
            inside = depth = 0
            group, before = None, file
        begin[file, start] = (inside, depth, group)
        # An entry that is open at the end began here, unless the whole split lies within one that was open before.
        group = start if depth < 3 or depth + change[2 + inside] <= 2 else group
        inside, depth = inside ^ parity, depth + change[inside]
    columns = ["file", "start", "group", "entry", "list", "bracket", "kind"]

    def cut(batches):
        for out in _chunks(_splits(batches, lambda file, start: _Entries(file, start, begin)), 4096):
            yield rows(columns, out).cast(schema)

    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("group", pa.int64()), ("entry", pa.string()), ("list", pa.string()), ("bracket", pa.string()), ("kind", pa.string())])
    kept = scratch(spark, "entries")
    pieces.mapInArrow(cut, "file string, start long, group long, entry string, list string, bracket string, kind string").write.partitionBy("kind").parquet(kept)
    found = spark.read.schema("file string, start long, group long, entry string, list string, bracket string, kind string").parquet(kept)
    heads, carried, head = found.filter("kind = 'head'").select("file", "start", "list", "bracket").collect(), [], (None, None)  # a row for each split
    for file, start, name, bracket in sorted(heads, key=lambda r: r[:2]):
        head = head if begin[file, start][:2] != (0, 0) or begin[file, start][2] is not None else (None, None)
        carried.append((file, start, *head))
        head = (name, bracket) if bracket else head
    carried = spark.createDataFrame(carried, "file string, start long, old string, old_bracket string")
    entries = found.filter("kind = 'entry'").join(F.broadcast(carried), ["file", "start"])
    entries = entries.select("file", "start", "group", "entry", F.coalesce("list", "old").alias("section"), F.coalesce("bracket", "old_bracket").alias("bracket")).filter("bracket = '['")
    whole = entries.filter("group IS NULL").select("entry", "section")
    parts = entries.filter("group IS NOT NULL").groupBy("file", "group").agg(F.array_sort(F.collect_list(F.struct("start", "entry", "section"))).alias("parts"))  # two for each split at most
    joined = parts.select(F.array_join(F.col("parts")["entry"], "").alias("entry"), F.col("parts")[0]["section"].alias("section"))
    out = scratch(spark, "sections")
    whole.unionByName(joined).write.partitionBy("section").text(out)
    return out


def _chunks(values, size: int):
    held = []
    for v in values:
        held.append(v)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def write_document(spark: SparkSession, path: str, lists: dict[str, tuple[DataFrame, list]], fixed: dict | None = None, tasks: int | None = None) -> str:
    """The file at path: one JSON object with the members of fixed, then a list for each of lists: its rows as objects, sorted by the columns named with them. An
    older file there is replaced when the new one is whole."""
    from .readers import _children, _fs
    from .writers import write_text

    temp = f"{path}.writing-{uuid.uuid4().hex}"
    fs, at = _fs(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    head, names = "{" + "".join(f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False)},\n" for k, v in (fixed or {}).items()), []
    for i, (name, (rows, order)) in enumerate(lists.items()):
        placed = numbered(rows.select(*order, F.to_json(F.struct(*rows.columns)).alias("_entry")), [*order, "_entry"], "_place", tasks)
        line = F.concat(F.when(F.col("_place") == 1, "").otherwise(","), F.col("_entry")).alias("value")
        placed.repartitionByRange(*([tasks] if tasks else []), "_place").sortWithinPartitions("_place").select(line).write.text(f"{temp}/{i}-list")
        write_text(spark, f"{temp}/{i}-head", ("" if i else head) + ("],\n" if i else "") + f"{json.dumps(name)}: [\n")
        names += [f"{temp}/{i}-head", *[f"{temp}/{i}-list/{n}" for n in _children(spark, f"{temp}/{i}-list") if n.startswith("part-")]]
    write_text(spark, f"{temp}/end", "]}\n" if lists else head.rstrip(",\n") + "}\n")
    out = fs.create(hadoop(f"{temp}/whole"), True)
    try:
        for n in [*names, f"{temp}/end"]:  # bytes from stream to stream, in the JVM
            part = fs.open(hadoop(n))
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, spark._jsc.hadoopConfiguration(), False)
            finally:
                part.close()
    finally:
        out.close()
    fs.delete(at, True)
    if not fs.rename(hadoop(f"{temp}/whole"), at):
        raise OSError(f"{temp}/whole could not be renamed to {path}")
    fs.delete(hadoop(temp), True)
    return path

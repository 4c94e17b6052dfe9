"""Readers and writers of the inventory's formats.

Headers are read on the driver from the first lines; rows are parsed by expressions.
A file is found and opened by Spark alone, so a path may be in any store that it reads.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


HEADER_LINES = 10_000
_TRUE, _FALSE = ("yes", "true", "+", "1"), ("no", "false", "-", "0")
_PAIRS = [{"yes", "no"}, {"true", "false"}, {"+", "-"}, {"0", "1"}]
_ATTRIBUTE = re.compile(r"@attribute\s+(?:'([^']*)'|\"([^\"]*)\"|(\S+))\s+(.+)", re.I)


class FormatError(ValueError):
    """A file that is not of its format; says where."""


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of one text file with their number in it."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split("value", "\r\n|\n|\r")).alias("at", "line"))


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """An ARFF file as a frame; missing values are null.

    A short or long row, or a value that is not of its column's type, is kept in
    `_corrupt` with its other columns null. A nominal attribute of two values that mean
    yes and no is a boolean. A file is split by lines, so it is not limited by a task.
    """
    text = spark.read.text(path)
    header: list[str] = []
    begun = False
    for r in text.limit(HEADER_LINES).toLocalIterator():
        if r.value.strip().lower().startswith("@data"):
            begun = True
            break
        header.append(r.value)
    first = next((h for h in map(str.strip, header) if h and not h.startswith("%")), "")
    if not begun or not first.startswith("@") and first:  # a longer header, or a folder whose first file has none: its lines are those that start with @
        header = [r.value for r in text.where(F.trim("value").startswith("@")).toLocalIterator()]
        begun = any(h.strip().lower().startswith("@data") for h in header)
        header = [h for h in header if not h.strip().lower().startswith("@data")]
    if not begun:
        raise FormatError(f"{path}: no @data")
    fields, related = [], False
    for i, raw in enumerate(header):
        line = raw.strip()
        if not line or line.startswith("%"):
            continue
        if line.lower().startswith("@relation"):
            if fields:
                raise FormatError(f"{path}:{i + 1}: @relation after @attribute")
            related = True
        elif m := _ATTRIBUTE.match(line):
            fields.append((m[1] or m[2] or m[3], m[4].strip()))
        else:
            raise FormatError(f"{path}:{i + 1}: {line[:10]}")
    if not related:
        raise FormatError(f"{path}: no @relation")
    if len(fields) < 2:
        raise FormatError(f"{path}: fewer than two attributes")
    line = F.trim("value")
    data = text.where((F.length(line) > 0) & ~line.startswith("%") & ~line.startswith("@"))
    sparse = line.startswith("{")
    cells = F.transform(F.split(line, r"[,\t]"), lambda x: F.regexp_replace(F.trim(x), r"^(['\"])(.*)\1$", "$2"))
    entries = F.map_from_entries(F.transform(F.filter(F.split(F.regexp_replace(line, r"[{}]", ""), ","), lambda x: F.length(F.trim(x)) > 0), lambda e: F.struct(F.split(F.trim(e), r"\s+")[0].cast("int").alias("k"), F.element_at(F.split(F.trim(e), r"\s+"), -1).alias("v"))))
    cell = lambda i: F.nullif(F.when(sparse, F.coalesce(F.element_at(entries, F.lit(i)), F.lit("0"))).otherwise(F.get(cells, i)), F.lit("?"))
    parsed = [(name, cell(i), *_arff_type(kind)) for i, (name, kind) in enumerate(fields)]
    fits = sparse | (F.size(cells) == len(fields))
    for _, raw, _, valid in parsed:
        fits = fits & (raw.isNull() | valid(raw))
    out = data.select(*(F.when(fits, convert(raw)).alias(name) for name, raw, convert, _ in parsed), F.when(~fits, F.col("value")).alias("_corrupt"))
    return out


def _arff_type(kind: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """A conversion and a test of a cell."""
    low = kind.lower()
    if low.startswith("{"):
        values = [v.strip().strip("'\"") for v in kind.strip("{} ").split(",")]
        if len(values) == 2 and {v.lower() for v in values} in _PAIRS:
            return (lambda x: F.when(F.lower(x).isin(*_TRUE), True).when(F.lower(x).isin(*_FALSE), False)), (lambda x: F.lower(x).isin(*_TRUE, *_FALSE))
        return (lambda x: x), (lambda x: x.isin(*values))
    if low in ("float", "real", "numeric"):
        return (lambda x: x.try_cast("double")), (lambda x: x.try_cast("double").isNotNull())
    if low == "integer":
        return (lambda x: x.try_cast("long")), (lambda x: x.try_cast("long").isNotNull())
    if low == "string" or low.startswith("date"):
        return (lambda x: x), (lambda x: F.lit(True))
    raise FormatError(f"attribute type {kind}")


def read_jdb(spark: SparkSession, path: str) -> DataFrame:
    """A JDB file: a name, a line of `name kind` pairs, then rows split by white space; symbols stay strings."""
    text = spark.read.text(path)
    head = [r.value.strip() for r in text.limit(HEADER_LINES).toLocalIterator() if r.value.strip() and not r.value.strip().startswith(";")][:2]
    if len(head) < 2:
        raise FormatError(f"{path}: no attribute line")
    words = head[1].split()
    pairs = list(zip(words[::2], words[1::2]))
    kinds = {"numerical": "double", "symbolic": "string", "name": "string"}
    for name, kind in pairs:
        if kind not in kinds and not (kind == kind.upper() and kind.lower() in kinds):
            raise FormatError(f"{path}: attribute {name} of kind {kind}")
    line = F.trim("value")
    cells = F.split(line, r"\s+")
    data = text.where((F.length(line) > 0) & ~line.startswith(";") & ~line.isin(*head))
    return data.select(*(F.nullif(F.get(cells, i), F.lit("?")).try_cast(kinds[kind.lower()]).alias(name) for i, (name, kind) in enumerate(pairs)))


def dictionary(df: DataFrame, column: str, order: str) -> DataFrame:
    """value, code: symbols in the order in which they first appear; symbols are few."""
    from pyspark.sql import Window

    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first"))
    return first.select("value", (F.row_number().over(Window.orderBy("first", "value")) - 1).alias("code"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_xml(spark: SparkSession, path: str, row: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).load(path)


def read_libsvm(spark: SparkSession, path: str) -> DataFrame:
    """label and a sparse vector (map<int,double>, indices from 1) of each line."""
    parts = F.split(F.trim("value"), r"\s+")
    pairs = F.transform(F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.contains(":")), lambda x: F.struct(F.split(x, ":")[0].cast("int").alias("key"), F.split(x, ":")[1].cast("double").alias("value")))
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(parts[0].cast("double").alias("label"), F.map_from_entries(pairs).alias("features"))


def read_front(spark: SparkSession, path: str, objectives: int) -> DataFrame:
    """Points of a file of numbers split by white space, `objectives` to a point. The file is one row: fronts are small."""
    numbers = F.transform(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: F.length(x) > 0), lambda x: x.cast("double"))
    points = spark.read.text(path, wholetext=True).select(numbers.alias("n"))
    each = points.select("n", F.explode(F.sequence(F.lit(0), F.floor(F.size("n") / objectives).cast("int") - 1)).alias("at"))
    return each.select("at", *(F.col("n")[F.col("at") * objectives + i].alias(f"f{i + 1}") for i in range(objectives)))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size and time of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


READERS: dict[str, Callable[..., DataFrame]] = {"arff": read_arff, "jdb": read_jdb, "txt": read_text, "xml": read_xml, "libsvm": read_libsvm, "pf": read_front}


def read(spark: SparkSession, path: str, *more) -> DataFrame:
    """By the extension, which has to match whole."""
    extension = path.rsplit(".", 1)[-1].lower()
    if extension == "parquet":
        return spark.read.parquet(path)
    if extension == "json":
        return spark.read.json(path)
    if extension not in READERS:
        raise FormatError(f"no reader of .{extension}")
    return READERS[extension](spark, path, *more)


def looks_like_text(sample: bytes) -> bool:
    """Whether the first 256 bytes hold no control character but tab and line ends."""
    return all(b >= 32 or b in (9, 10, 13) for b in sample[:256])


def text_like(value: Column) -> Column:
    """looks_like_text of a column of texts, by their first 256 characters."""
    return ~F.substring(value, 1, 256).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


class TraceAutosave:
    """Collects results of a run and writes them as a table whenever `every` more have come (K4)."""

    def __init__(self, spark: SparkSession, path: str, every: int = 100):
        self.spark, self.path, self.every = spark, path, every
        self._new: list[tuple[int, str, float]] = []
        self._node = 0

    def push(self, name: str, value: float, node: int | None = None) -> None:
        """A named result of a node (or of the one that is open)."""
        self._new.append((self._node if node is None else node, name, float(value)))
        if len(self._new) >= self.every:
            self.save()

    def next_node(self) -> None:
        self._node += 1

    def save(self) -> None:
        if self._new:
            self.spark.createDataFrame(self._new, "node long, name string, value double").coalesce(1).write.mode("append").parquet(self.path)
            self._new = []

    def table(self) -> DataFrame:
        """What has been written, one row a node and a column a name."""
        self.save()
        return trace_table(self.spark.read.parquet(self.path), "node", "name", "value")


class Console:
    """Tells a run's scopes, results and progress as indented lines (K5)."""

    def __init__(self, out=None):
        import sys

        self.out, self.depth = out or sys.stdout, 0

    def _say(self, text: str) -> None:
        print("  " * self.depth + text, file=self.out)

    def enter(self, scope: str) -> None:
        self._say(scope)
        self.depth += 1

    def leave(self, value=None) -> None:
        self.depth = max(0, self.depth - 1)
        if value is not None:
            self._say(f"=> {value}")

    def result(self, name: str, value) -> None:
        self._say(f"{name} = {value}")

    def progress(self, done: float, total: float, unit: str = "") -> None:
        self._say(f"{done:g}/{total:g} {unit}".rstrip())


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, JSON or XML by the extension."""
    extension = path.rsplit(".", 1)[-1].lower()
    writer = df.write.mode(mode)
    if extension == "xml":
        writer.format("xml").option("rowTag", "row").save(path)
    elif extension == "json":
        writer.json(path)
    else:
        writer.parquet(path)


def save_trace(trace: DataFrame, path: str) -> None:
    """A trace with the types of its columns: JSON lines beside a file of the schema."""
    trace.write.json(f"{path}/rows")
    trace.sparkSession.createDataFrame([(trace.schema.json(),)], "value string").coalesce(1).write.text(f"{path}/schema")


def load_trace(spark: SparkSession, path: str) -> DataFrame:
    import json

    from pyspark.sql.types import StructType

    schema = StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first().value))
    return spark.read.schema(schema).json(f"{path}/rows")


def sparse_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, index, value of the elements of an array that are not null."""
    return df.select(key, F.posexplode(vector).alias("index", "value")).where("value is not null")


def trace_table(trace: DataFrame, node: str, name: str, value: str, names: list[str] | None = None) -> DataFrame:
    """One row for each node and a column for each result name; of several values of a name the last by order of value."""
    grouped = trace.groupBy(node)
    return (grouped.pivot(name, names) if names else grouped.pivot(name)).agg(F.max(value))


def widest(kinds: list[str]) -> str:
    """The type that holds values of all these types."""
    if len(set(kinds)) == 1:
        return kinds[0]
    return "double" if set(kinds) <= {"boolean", "int", "long", "bigint", "double"} and "boolean" not in kinds else "string"


def random_stream(spark: SparkSession, rows_per_second: int, columns: dict[str, Column]) -> DataFrame:
    """An endless stream of samples: expressions of `value`, the number of the row."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select("timestamp", "value", *(c.alias(n) for n, c in columns.items()))


def random_batch(spark: SparkSession, rows: int, columns: dict[str, Column]) -> DataFrame:
    return spark.range(rows).withColumnRenamed("id", "value").select("value", *(c.alias(n) for n, c in columns.items()))



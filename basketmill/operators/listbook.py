"""Item lists kept from run to run.

A list is a stored table named by what it hangs on: its name, the cutoff, its sizes, and digests
of the log and the catalogue. Its entry is one small file that is written after the table, so a
run that dies leaves no entry and a reader never sees half a list; a second writer of the same
list writes the same rows, and the last entry counts. Input that changed has another digest, and
so never meets an old list.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Facts = Mapping[str, object]

# Plans with these are not told apart by their text.
OPAQUE = ("python", "udf", "mapin", "map_in", "rand", "uuid(", "scan existingrdd", "localrelation", "logicalrdd")
_FIELDS = "spark.sql.debug.maxToStringFields"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _plan_text(df: DataFrame) -> str:
    """The whole plan as text in which expression numbers do not depend on the session."""
    conf = df.sparkSession.conf
    before = conf.get(_FIELDS)
    conf.set(_FIELDS, "100000")
    try:
        return df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    finally:
        conf.set(_FIELDS, before)


def _files(df: DataFrame) -> list[str]:
    """Each input file with its size and time of change."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    out = []
    for name in sorted(df.inputFiles()):
        place = path(name)
        status = place.getFileSystem(conf).getFileStatus(place)
        out.append(f"{name}|{status.getLen()}|{status.getModificationTime()}")
    return out


def content_digest(df: DataFrame) -> str:
    """Of all rows as a bag: one pass without a shuffle."""
    cells = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    other = F.xxhash64(F.lit(1), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    row = df.agg(
        F.count(F.lit(1)), F.sum(cells.cast("decimal(38,0)")), F.bit_xor(cells), F.sum(other.cast("decimal(38,0)"))
    ).first()
    return _sha(json.dumps([sorted(df.columns), *map(str, row)]))


def input_digest(df: DataFrame) -> str:
    """Changes when the rows of ``df`` may have. Where files and plain columns are all that it is
    made of, their names, sizes and times are compared and nothing is read; else its rows are."""
    text = _plan_text(df)
    files = _files(df)
    if not files or any(word in text.lower() for word in OPAQUE):
        return content_digest(df)
    return _sha(json.dumps([text, files]))


class ListBook:
    """Lists under the folder ``root``, which every run and executor can reach.

    ``refresh`` builds every list anew, once for each book. ``built`` names the lists that this
    book has had to build."""

    def __init__(self, spark: SparkSession, root: str, refresh: bool = False):
        self.spark, self.root, self.refresh = spark, root.rstrip("/"), refresh
        self.built: list[str] = []
        self._fresh: set[str] = set()

    def _path(self, place: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(place)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entry(self, key: str) -> str:
        return f"{self.root}/entries/{key}.json"

    def find(self, key: str) -> dict | None:
        path, files = self._path(self._entry(key))
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, key: str, entry: dict) -> None:
        path, files = self._path(self._entry(key))
        stream = files.create(path, True)
        try:
            stream.write(json.dumps(entry, sort_keys=True).encode())
        finally:
            stream.close()

    def keep(self, name: str, facts: Facts, build: Callable[[], DataFrame]) -> DataFrame:
        """The list of these facts, built and published if the book does not hold it."""
        key = _sha(json.dumps([name, dict(facts)], sort_keys=True, default=str))
        entry = None if self.refresh and key not in self._fresh else self.find(key)
        if entry is None:
            table = build()
            place = f"{self.root}/lists/{name}-{uuid.uuid4().hex}"
            table.write.parquet(place)
            entry = {"name": name, "facts": dict(facts), "path": place, "schema": table.schema.json()}
            self._publish(key, entry)
            self.built.append(name)
            self._fresh.add(key)
        return self.spark.read.parquet(entry["path"])

    def entries(self) -> list[dict]:
        """What the book holds."""
        path, files = self._path(f"{self.root}/entries")
        if not files.exists(path):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(path))
        return [self.find(n.removesuffix(".json")) for n in names if n.endswith(".json")]


def set_digest(df: DataFrame, column: str) -> str:
    """Of the values of a column of distinct values."""
    marks = [F.xxhash64(F.lit(i), F.col(column)) for i in range(2)]
    row = df.agg(F.count(F.lit(1)), *[F.sum(m.cast("decimal(38,0)")) for m in marks]).first()
    return reduce(lambda a, b: f"{a}/{b}", map(str, row))

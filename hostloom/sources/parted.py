"""Tables in parts: merges and deletes rewrite the parts they touch and no others.

A table is a folder of written parts and a folder of numbered versions. A version is a small
file that says for every part which write holds it. A change writes the new parts beside the
old ones and then moves the version by a rename that fails if somebody else was first, so
readers see one version or the other, a crash in between changes nothing, and of two writers
one gets :class:`ClashError` and starts again from the new version.
"""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from collections.abc import Iterable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hostloom.sources.merges import one_per_key, upsert

#: Column that names the part in the folders of a write.
PART = "hl_part"


class ClashError(RuntimeError):
    """Another writer has moved the table on meanwhile."""


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor reaches; only a plain local master may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="hostloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/hostloom-{uuid.uuid4().hex}"


class Folder:
    """The few file operations that versions need, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.none = spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self.path = path.rstrip("/")

    def at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self.at().getFileSystem(self.conf)

    def entries(self, name: str = "") -> dict[str, int]:
        """Names below a folder with their modification times in milliseconds; none if it isn't there."""
        fs, path = self._fs(), self.at(name)
        return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(path)} if fs.exists(path) else {}

    def text(self, name: str) -> str:
        stream = self._fs().open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create_once(self, name: str, text: str) -> None:
        """Write a whole file under a name that nobody has yet, by a rename."""
        aside = f".{uuid.uuid4().hex}"
        fs = self._fs()
        stream = fs.create(self.at(aside), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at().toUri(), self.conf)
        try:
            files.rename(self.at(aside), self.at(name), self.none)
        except Py4JJavaError as error:
            fs.delete(self.at(aside), False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise ClashError(f"{self.path}/{name} is there already") from None
            raise

    def remove(self, name: str) -> None:
        self._fs().delete(self.at(name), True)


class Versions:
    """Numbered versions of something; each number is given once."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in self.folder.entries() if n.isdigit())

    def latest(self) -> tuple[int, str | None]:
        """The last number and its text; 0 and None before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.folder.text(str(numbers[-1]))) if numbers else (0, None)

    def add(self, base: int, text: str) -> int:
        """Make ``base + 1`` the last version, or raise :class:`ClashError`."""
        self.folder.create_once(str(base + 1), text)
        return base + 1


class PartedTable:
    """A keyed Parquet table in parts.

    ``part`` names a row's part and must follow from its key: a bucket of the key (the default,
    ``parts`` of them), or the day for a key that holds the time. A change costs the parts
    it touches; choose ``parts`` so that one is about a file of good size.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, part: Column | None = None, parts: int = 64):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        label = F.pmod(F.xxhash64(key), F.lit(parts)) if part is None else part
        self.part = F.coalesce(label.cast("string"), F.lit("none"))
        self.versions, self.data = Versions(spark, f"{self.path}/versions"), Folder(spark, f"{self.path}/data")

    def _state(self) -> tuple[int, dict]:
        number, text = self.versions.latest()
        return number, json.loads(text) if text else {"schema": None, "parts": {}}

    def version(self) -> int:
        """Number of the current version, 0 before the first write."""
        return self._state()[0]

    def parts(self) -> dict[str, str]:
        """Each part's folder in the current version."""
        return {p: f"{self.path}/data/{w}/{PART}={p}" for p, w in self._state()[1]["parts"].items()}

    def _rows(self, state: dict, only: Iterable[str] | None = None) -> DataFrame:
        if state["schema"] is None:
            raise ValueError(f"{self.path} has no version yet")
        schema = StructType.fromJson(state["schema"])
        wanted = state["parts"] if only is None else [p for p in only if p in state["parts"]]
        paths = [f"{self.path}/data/{state['parts'][p]}/{PART}={p}" for p in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, only: Sequence[str] | None = None) -> DataFrame:
        """The current version, or some of its parts; the files of others aren't listed."""
        return self._rows(self._state()[1], only)

    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """Write rows by part; the write's name and its parts."""
        write = uuid.uuid4().hex
        label = rows.withColumn(PART, self.part)
        label.repartition(PART, F.pmod(F.xxhash64(self.key), F.lit(4))).write.partitionBy(PART).parquet(f"{self.path}/data/{write}")
        found = [n.split("=", 1)[1] for n in self.data.entries(write) if n.startswith(f"{PART}=")]
        odd = [p for p in found if not re.fullmatch(r"[A-Za-z0-9.-]+", p)]
        if odd:
            raise ValueError(f"part names are letters, digits, dots and hyphens: {odd[:3]}")
        return write, found

    def _change(self, base: int, state: dict, rows: DataFrame, touched: Iterable[str]) -> int:
        """Next version, in which ``rows`` stand for all rows of the touched parts."""
        write, found = self._write(rows)
        gone = set(touched)
        if not set(found) <= gone:
            raise ValueError(f"a row's part must follow from its key; unexpected {sorted(set(found) - gone)[:3]}")
        parts = {p: w for p, w in state["parts"].items() if p not in gone} | dict.fromkeys(found, write)
        return self._commit(base, {"schema": rows.schema.jsonValue(), "parts": parts})

    def _commit(self, base: int, state: dict) -> int:
        return self.versions.add(base, json.dumps(state, sort_keys=True))

    def _labels(self, rows: DataFrame) -> list[str]:
        """The parts of some rows: at most as many values as the table has parts."""
        return [r[0] for r in rows.select(self.part).distinct().collect()]

    def replace(self, rows: DataFrame) -> int:
        """The whole table anew. Old versions stay readable until :meth:`sweep`."""
        base, _ = self._state()
        write, found = self._write(rows)
        return self._commit(base, {"schema": rows.schema.jsonValue(), "parts": dict.fromkeys(found, write)})

    def merge(self, new: DataFrame, supplied: Sequence[str], order: Sequence[Column] = ()) -> int:
        """Upsert a batch (see :func:`~hostloom.sources.merges.upsert`); into nothing, it becomes the table. An empty batch changes nothing."""
        base, state = self._state()
        if state["schema"] is None:
            return self.replace(one_per_key(new, self.key, order).select(self.key, *supplied))
        touched = self._labels(new)
        return self._change(base, state, upsert(self._rows(state, touched), new, self.key, supplied, order), touched) if touched else base

    def delete(self, condition: Column) -> int:
        """Without the rows that meet the condition (NULL does not). Parts that hold none keep their files."""
        base, state = self._state()
        meets = F.coalesce(condition, F.lit(False))
        touched = self._labels(self._rows(state).where(meets))
        return self._change(base, state, self._rows(state, touched).where(~meets), touched) if touched else base

    def drop(self, parts: Iterable[str]) -> int:
        """Without whole parts: no data file is read or written."""
        base, state = self._state()
        gone = set(parts)
        left = {p: w for p, w in state["parts"].items() if p not in gone}
        return base if left == state["parts"] else self._commit(base, state | {"parts": left})

    def sweep(self, keep: int = 2, older_than_s: float = 86_400) -> list[str]:
        """Remove writes that none of the last ``keep`` versions names and that are older than any running change; returns their names."""
        named = set()
        for number in self.versions.numbers()[-keep:]:
            named |= set(json.loads(self.versions.folder.text(str(number)))["parts"].values())
        limit = (time.time() - older_than_s) * 1000
        old = [w for w, at in self.data.entries().items() if w not in named and at <= limit]
        for write in old:
            self.data.remove(write)
        return old


def append_once(rows: DataFrame, path: str, run: str, at: str = "observed_at") -> None:
    """Append a run's rows to a history, by run and day; a run that is repeated replaces its own rows only.

    Readers see the columns ``run`` and ``day`` as well; a filter on ``day`` prunes folders.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", run):
        raise ValueError("run names are letters, digits, dots, underscores and hyphens")
    rows.withColumn("day", F.to_date(at)).write.mode("overwrite").partitionBy("day").parquet(f"{path.rstrip('/')}/run={run}")


def batch_appender(path: str, name: str, at: str = "observed_at"):
    """A function for ``foreachBatch``: each batch is a run of its own, so a batch tried twice is there once."""

    def append(rows: DataFrame, batch: int) -> None:
        append_once(rows, path, f"{name}-{batch:012d}", at)

    return append

"""State between runs: Parquet folders, and a manifest that names the ones that count.

Nothing is overwritten. A write makes a new folder, and a transaction ends by adding the next
manifest file in one rename; a run that dies before leaves folders nobody names, and every
reader sees all of a transaction or nothing of it. Of two runs that end at once, the second
fails.

Tables of a day have one folder per date. Tables keyed by article have a base and, for every
run, a folder of changes (new rows of the keys that changed, and marks for keys that went);
reading takes the newest rows of each key. A day with one changed article writes one small
folder. When the changes outgrow a share of the base, the run that finds it merges them.

The manifest also keeps the schema of each folder. Columns added or widened since are filled
or widened when read; a table that lost or narrowed a column is refused.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.schemas import STATE_TABLES
from storyloom.session import cut

_NO_STATE = {"version": 0, "tables": {}, "counters": {}}

# What a stored type may be read as.
_WIDER = {
    "tinyint": ["smallint", "int", "bigint", "double"],
    "smallint": ["int", "bigint", "double"],
    "int": ["bigint", "double"],
    "float": ["double"],
    "date": ["timestamp_ntz"],
}


class SchemaError(ValueError):
    """A stored table does not fit its declared schema."""


class ConcurrentRunError(RuntimeError):
    """Another run has changed the state since this one read it."""


def check_schema(name: str, stored: T.StructType, declared: T.StructType) -> None:
    """Every stored column has to be declared, with the same type or a wider one."""
    types = {f.name: f.dataType.simpleString() for f in declared.fields}
    for field in stored.fields:
        had = field.dataType.simpleString()
        now = types.get(field.name)
        if now is None:
            raise SchemaError(f"{name}: stored column {field.name} is not declared any more")
        if now != had and now not in _WIDER.get(had, []):
            raise SchemaError(f"{name}: {field.name} is stored as {had}, which {now} can't hold")


class StateStore:
    """Reads and writes the state tables under ``root``."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        change_share: float = 0.25,
        max_changes: int = 64,
        tables: dict[str, tuple[str, list[str]]] = STATE_TABLES,
    ) -> None:
        """Changes are merged into the base beyond that share of its bytes, or that many."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.change_share, self.max_changes = change_share, max_changes
        self.tables = tables
        self._pending: dict | None = None

    # Files

    def _hadoop_path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return self._hadoop_path(self.root).getFileSystem(conf)

    def _names(self, folder: str) -> list[str]:
        path = self._hadoop_path(folder)
        if not self._files().exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._files().listStatus(path))

    def _bytes(self, folder: str) -> int:
        return self._files().getContentSummary(self._hadoop_path(folder)).getLength()

    # Manifests

    def _versions(self) -> list[str]:
        return [n for n in self._names(f"{self.root}/_manifests") if n.endswith(".json")]

    def _manifest(self, file: str) -> dict:
        stream = self._files().open(self._hadoop_path(f"{self.root}/_manifests/{file}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _current(self) -> dict:
        if self._pending is not None:
            return self._pending
        versions = self._versions()
        return self._manifest(versions[-1]) if versions else copy.deepcopy(_NO_STATE)

    @contextmanager
    def transaction(self) -> Iterator[StateStore]:
        """All writes inside count together at the end, or not at all.

        Reads inside see them already. An inner transaction is part of the outer one.
        """
        if self._pending is not None:
            yield self
            return
        self._pending = self._current()
        try:
            yield self
            self._commit(self._pending)
        finally:
            self._pending = None

    def _commit(self, manifest: dict) -> None:
        folder = f"{self.root}/_manifests"
        manifest["version"] += 1
        written = self._hadoop_path(f"{folder}/new-{uuid.uuid4().hex}")
        out = self._files().create(written, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(
            self._hadoop_path(folder).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()
        )
        try:  # a rename that never replaces
            target = self._hadoop_path(f"{folder}/{manifest['version']:012d}.json")
            context.rename(
                self._files().makeQualified(written),
                self._files().makeQualified(target),
                gateway.new_array(fs.Options.Rename, 0),
            )
        except (PySparkException, Py4JJavaError) as error:
            self._files().delete(written, False)
            raise ConcurrentRunError(f"version {manifest['version']} is there already") from error

    def counter(self, name: str) -> int:
        return self._current()["counters"].get(name, 0)

    def set_counter(self, name: str, value: int) -> None:
        with self.transaction():
            self._pending["counters"][name] = value

    # Reading

    def _declared(self, name: str) -> T.StructType:
        return T.StructType.fromDDL(self.tables[name][0])

    def parts(self, name: str) -> list[dict]:
        return self._current()["tables"].get(name, [])

    def dates(self, name: str) -> list[str]:
        """The dates a table of days has rows for, in order."""
        return sorted(p["date"] for p in self.parts(name))

    def _scan(self, name: str, parts: list[dict], extra: str = "") -> DataFrame:
        declared = self._declared(name)
        for part in parts:
            check_schema(name, T.StructType.fromJson(json.loads(part["schema"])), declared)
        schema = T.StructType([*declared.fields, *(T.StructType.fromDDL(extra).fields if extra else [])])
        if not parts:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.root}/{name}/{p['folder']}" for p in parts]
        inferred = T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])
        found = self.spark.read.schema(inferred).option("basePath", f"{self.root}/{name}").parquet(*folders)
        return found.select(*[F.col(f.name) for f in schema.fields])

    def read(self, name: str, since: str | None = None, before: str | None = None) -> DataFrame:
        """The table, or an empty one; of a table of days, those in [since, before)."""
        parts = self.parts(name)
        if not parts or "date" in parts[0]:
            return self._scan(
                name,
                [p for p in parts if (since is None or p["date"] >= since) and (before is None or p["date"] < before)],
            )
        return self._newest(name, parts)

    def _newest(self, name: str, parts: list[dict]) -> DataFrame:
        """The base with the newest change of every key in place of its rows."""
        state = self._scan(name, [p for p in parts if "keys" not in p])
        changed = sorted((p for p in parts if "keys" in p), key=lambda p: p["change"])
        for keys, run in groupby(changed, key=lambda p: p["keys"]):
            run = list(run)
            rows = self._scan(name, run, "change bigint, gone boolean")
            if len(run) > 1:
                newest = F.max("change").over(Window.partitionBy(*keys))
                rows = rows.withColumn("_newest", newest).where("change = _newest").drop("_newest")
            kept = state.join(rows.select(*keys).distinct(), keys, "left_anti")
            state = kept.unionByName(rows.where("NOT gone").select(*state.columns))
        return state

    # Writing

    def _shaped(self, name: str, rows: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
        return rows.select(
            *[
                (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in self._declared(name).fields
                if f.name not in without
            ]
        )

    def _put(self, name: str, rows: DataFrame, inside: str = "", **about) -> dict:
        folder = f"attempt=a{uuid.uuid4().hex}{inside}"
        rows.write.parquet(f"{self.root}/{name}/{folder}")
        size = self._bytes(f"{self.root}/{name}/{folder}")
        return {"folder": folder, "schema": self._declared(name).json(), "bytes": size, **about}

    def _set_parts(self, name: str, parts: list[dict]) -> None:
        self._pending["tables"][name] = parts

    def replace_date(self, name: str, rows: DataFrame, date: str) -> None:
        """Exactly ``rows`` for ``date`` afterwards, even when there are none."""
        with self.transaction():
            others = [p for p in self.parts(name) if p["date"] != date]
            if not rows.isEmpty():
                shaped = self._shaped(name, rows, without=("date",))
                others.append(self._put(name, shaped, f"/date={date}", date=date))
            self._set_parts(name, others)

    def replace_dates(self, name: str, rows: DataFrame) -> None:
        """Exactly ``rows`` for every date they have, in one write; other dates stay."""
        with self.transaction():
            attempt = f"attempt=a{uuid.uuid4().hex}"
            folder = f"{self.root}/{name}/{attempt}"
            self._shaped(name, rows).write.partitionBy("date").parquet(folder)
            made = [n for n in self._names(folder) if n.startswith("date=")]
            schema = self._declared(name).json()
            parts = [
                {"folder": f"{attempt}/{n}", "schema": schema, "bytes": self._bytes(f"{folder}/{n}"), "date": n[5:]}
                for n in made
            ]
            dates = {p["date"] for p in parts}
            self._set_parts(name, [*(p for p in self.parts(name) if p["date"] not in dates), *parts])

    def append(self, name: str, rows: DataFrame) -> None:
        """More rows of a table without dates or changes."""
        with self.transaction():
            self._set_parts(name, [*self.parts(name), self._put(name, self._shaped(name, rows))])

    def replace_keys(
        self,
        name: str,
        changes: DataFrame,
        stale: DataFrame | None = None,
        keys: list[str] | None = None,
    ) -> None:
        """Drop the rows whose key is in ``changes`` or ``stale``, then add ``changes``.

        Only the changes are written, unless they make the merge due.
        """
        keys = keys or self.tables[name][1]
        with self.transaction():
            rows = self._shaped(name, changes).withColumn("gone", F.lit(False))
            rows = cut(rows)
            if stale is not None:
                gone = stale.select(*keys).distinct().join(rows.select(*keys), keys, "left_anti")
                marks = self._shaped(name, gone).withColumn("gone", F.lit(True))
                rows = cut(rows.unionByName(marks))
            if rows.isEmpty():
                return
            change = self._pending["counters"].get("change", 0) + 1
            self._pending["counters"]["change"] = change
            parts = self.parts(name)
            if not parts:
                if rows.where("NOT gone").isEmpty():
                    return
                self._set_parts(name, [self._put(name, rows.where("NOT gone").drop("gone"))])
                return
            parts = [*parts, self._put(name, rows, f"/change={change}", keys=keys, change=change)]
            self._set_parts(name, parts)
            changed = [p for p in parts if "keys" in p]
            base = sum(p["bytes"] for p in parts if "keys" not in p)
            if len(changed) > self.max_changes or sum(p["bytes"] for p in changed) > self.change_share * base:
                self.merge_changes(name)

    def merge_changes(self, name: str) -> None:
        """Write the table as it reads now as its new base."""
        with self.transaction():
            merged = self._newest(name, self.parts(name))
            # Folders that are read stay; they are only not named any more.
            self._set_parts(name, [self._put(name, merged.hint("rebalance"))])

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove folders that none of the last ``keep`` manifests names, and older manifests.

        Must not run beside another run.
        """
        versions = self._versions()
        named = {
            f"{name}/{p['folder'].split('/')[0]}"
            for file in versions[-keep:]
            for name, parts in self._manifest(file)["tables"].items()
            for p in parts
        }
        removed = []
        for name in self.tables:
            for attempt in self._names(f"{self.root}/{name}"):
                if attempt.startswith("attempt=") and f"{name}/{attempt}" not in named:
                    self._files().delete(self._hadoop_path(f"{self.root}/{name}/{attempt}"), True)
                    removed.append(f"{name}/{attempt}")
        for file in self._names(f"{self.root}/_manifests"):
            if file not in versions[-keep:]:
                self._files().delete(self._hadoop_path(f"{self.root}/_manifests/{file}"), False)
        return removed

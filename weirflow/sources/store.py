"""Tables as versioned Parquet snapshots behind a pointer.

A write goes to a new snapshot folder; then the pointer file is replaced.  The
snapshot being read is never touched, and a failed write, or one that its check
refuses, leaves the pointer where it was.  Who replaces a pointer first claims
the version that he has read, by a file that can be made only once: of two
writers that begin with the same version one gets a ``Conflict``.  All file operations go through Hadoop's file system API, so the
store may lie wherever Spark can write and files are made and renamed atomically (HDFS, local disks; object stores need a
committer that promises as much).

A partitioned table remembers which folder holds which of its partitions, so replacing a window writes the window and
nothing else.  Properties move with the pointer: what a write means for later runs is recorded in the same step that makes it
visible.  Earlier versions can be read until ``vacuum`` deletes their folders.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.operators import merge
from weirflow.sources import layout as L

POINTER, CLAIMS = "_current", "_claims"
SMALL_FILE = 16 * 1024 * 1024
PAST = 20  #: earlier versions that a pointer remembers
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  #: fixed value: what Spark names the partition of nulls


class Conflict(RuntimeError):
    """Another writer has replaced the version that this one began with."""


class Abandoned(RuntimeError):
    """The run that this thread works for has been given up."""


_own = threading.local()  #: ``run``: the run that a thread works for
_abandoned: set[str] = set()
_moving = threading.Lock()


def work_for(run: str) -> None:
    """This thread works for a run, which can be given up."""
    _own.run = run


def abandon(run: str) -> None:
    """From now on threads that work for a run move no pointers: a move that is under way is waited for, later ones are refused."""
    with _moving:
        _abandoned.add(run)


Check = Callable[[DataFrame], object]  #: raises if what is about to become visible must not
Notes = Callable[[DataFrame, dict[str, str]], dict[str, str]]  #: what was written, the properties so far -> properties to be set with it


@dataclass(frozen=True)
class Layout:
    """How a table's files are dealt: partition columns, or clustering columns sorted within ranges."""

    partition_by: tuple[str, ...] = ()
    cluster_by: tuple[str, ...] = ()


@dataclass
class ParquetStore:
    """Named tables under one root."""

    spark: SparkSession
    root: str
    layouts: dict[str, Layout] = field(default_factory=dict)

    # -- files ---------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _path(self, name: str, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), name.replace(".", "/"), *parts])

    def _pointer(self, name: str) -> dict | None:
        fs, path = self._fs(self._path(name, POINTER))
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, name: str, state: dict) -> None:
        """Claim the version before, write the pointer beside the old one, then put it in its place."""
        with _moving:
            if getattr(_own, "run", None) in _abandoned:
                raise Abandoned(name)
            self._move(name, state)

    def _move(self, name: str, state: dict) -> None:
        self._claim(name, state["version"] - 1)
        fs, fresh = self._fs(self._path(name, f"{POINTER}.{state['version']}.{uuid.uuid4().hex[:8]}.tmp"))
        stream = fs.create(fresh, True)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        _, path = self._fs(self._path(name, POINTER))
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(fresh, path, options)

    def _claim(self, name: str, version: int) -> None:
        """Be the only one who succeeds a version."""
        fs, path = self._fs(self._path(name, CLAIMS, f"{version:06d}"))
        fs.mkdirs(path.getParent())
        if not fs.createNewFile(path):
            raise Conflict(f"{name}: version {version} has been succeeded")

    def recover(self, name: str) -> None:
        """Give up the claim of a writer that died before it replaced the pointer; only while nobody writes."""
        fs, path = self._fs(self._path(name, CLAIMS, f"{(self._pointer(name) or {'version': 0})['version']:06d}"))
        fs.delete(path, False)

    # -- reading -------------------------------------------------------------

    def exists(self, name: str) -> bool:
        return self._pointer(name) is not None

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The table as it is, or as it was at a version that is still there."""
        state = self._pointer(name)
        if state is None:
            raise KeyError(name)
        found = state if version is None else self._at(state, version)
        if found is None:
            raise KeyError(f"{name}, version {version}")
        return self._scan(name, found)

    def version(self, name: str) -> int | None:
        """The number of the version in which the table's rows last changed."""
        state = self._pointer(name) or {}
        return state.get("rows_version", state.get("version"))

    def readable(self, name: str, version: int | None) -> bool:
        """Whether an earlier version can be read: it is remembered and its folders are there."""
        state = self._pointer(name)
        found = self._at(state, version) if state and version is not None else None
        return found is not None and all(fs.exists(path) for fs, path in (self._fs(self._path(name, p)) for p in found["parts"]))

    def added(self, name: str, since: int | None) -> DataFrame | None:
        """Rows that appends have added since a version; None where the table has been rewritten or the version is not remembered."""
        state = self._pointer(name)
        then = self._at(state, since) if state and since is not None else None
        if then is None or set(then["parts"]) - set(state["parts"]):
            return None
        held = state.get("held", {})
        if any(then.get("held", {}).get(p) != held.get(p) for p in then["parts"]):
            return None
        new = [p for p in state["parts"] if p not in then["parts"]]
        return self._scan(name, state | {"parts": new, "held": {p: held[p] for p in new if p in held}})

    @staticmethod
    def _at(state: dict, version: int) -> dict | None:
        """What the table held at a version: the latest change of rows up to it."""
        known = {state.get("rows_version", state["version"]): state} | {int(v): x for v, x in state.get("past", {}).items()}
        upto = [v for v in known if v <= version]
        return known[max(upto)] if upto else None

    def _scan(self, name: str, found: dict) -> DataFrame:
        """The rows of a version; of partitioned folders only the partitions that count."""
        schema = T.StructType.fromJson(json.loads(found["schema"]))
        held = found.get("held", {})
        reader = lambda: self.spark.read.schema(schema)
        whole = [self._path(name, p) for p in found["parts"] if p not in held]
        frames = [reader().parquet(*whole)] if whole else []
        frames += [reader().option("basePath", self._path(name, p)).parquet(*(self._path(name, p, d) for d in dirs)) for p, dirs in held.items() if dirs]
        if not frames:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, frames).select(*(F.col(f"`{c}`") for c in schema.names))

    def read_or(self, name: str, schema: str) -> DataFrame:
        """The table, or an empty one."""
        return self.read(name) if self.exists(name) else self.spark.createDataFrame([], schema)

    # -- writing -------------------------------------------------------------

    def _write(self, name: str, df: DataFrame, version: int) -> tuple[str, list[str] | None]:
        """Write rows to a new folder in the table's layout: the folder, and its partitions if it has some."""
        layout = self.layouts.get(name, Layout())
        part = f"v{version:06d}-{uuid.uuid4().hex[:8]}"  # two writers of one version don't share a folder
        if layout.partition_by:
            df.hint("rebalance", *(F.col(c) for c in layout.partition_by)).write.partitionBy(*layout.partition_by).mode("overwrite").parquet(self._path(name, part))
            return part, self._partitions(name, part)
        if layout.cluster_by:
            df = df.repartitionByRange(*layout.cluster_by).sortWithinPartitions(*layout.cluster_by)
        else:
            df = df.hint("rebalance")
        df.write.mode("overwrite").parquet(self._path(name, part))
        return part, None

    def _partitions(self, name: str, part: str) -> list[str]:
        """The partitions in a folder, as relative paths."""
        fs, root = self._fs(self._path(name, part))

        def below(path, label: str) -> list[str]:
            names = [x.getPath() for x in fs.listStatus(path) if x.isDirectory() and "=" in x.getPath().getName()]
            found = [d for p in names for d in below(p, f"{label}/{p.getName()}" if label else p.getName())]
            return found or ([label] if label else [])

        return sorted(below(root, ""))

    def _publish(self, name: str, state: dict, parts: list[str], held: dict[str, list[str]], schema: T.StructType, written: tuple[str, list[str] | None], check: Check | None, notes: Notes | None) -> None:
        """Show ``check`` the table as it will be read, then move the pointer together with the properties that ``notes`` makes of what was written."""
        parts = [p for p in parts if p not in held or held[p]]
        layout = self.layouts.get(name, Layout())
        found = {"parts": parts, "held": {p: d for p, d in held.items() if d}, "schema": schema.json(), "layout": [list(layout.partition_by), list(layout.cluster_by)]}
        fresh = {"parts": [written[0]], "held": {} if written[1] is None else {written[0]: written[1]}, "schema": schema.json()}
        if check:
            check(self._scan(name, fresh if state.get("appending") else found))
        properties = dict(state["properties"])
        if notes:
            properties |= notes(self._scan(name, fresh), properties)
        past = dict(state.get("past", {}))
        if state["version"]:
            past[str(state.get("rows_version", state["version"]))] = {k: state[k] for k in ("parts", "held", "schema") if k in state}
        past = dict(sorted(past.items(), key=lambda x: int(x[0]))[-PAST:])
        self._point(name, {"version": state["version"] + 1, "rows_version": state["version"] + 1, "properties": properties, "past": past, **found})

    def _now(self, name: str) -> dict:
        return self._pointer(name) or {"version": 0, "parts": [], "properties": {}}

    def overwrite(self, name: str, df: DataFrame, check: Check | None = None, notes: Notes | None = None) -> None:
        """A new snapshot replaces all rows (and the schema), once ``check`` has seen it as it is stored."""
        state = self._now(name)
        part, dirs = written = self._write(name, df, state["version"] + 1)
        self._publish(name, state, [part], {} if dirs is None else {part: dirs}, _stored(df.schema), written, check, notes)

    def append(self, name: str, df: DataFrame, check: Check | None = None, notes: Notes | None = None) -> None:
        """Rows join the table, once ``check`` has seen them as they are stored; its files stay."""
        state = self._pointer(name)
        if state is None:
            return self.overwrite(name, df, check, notes)
        known = T.StructType.fromJson(json.loads(state["schema"]))
        more = [f for f in _stored(df.schema).fields if f.name not in known.names]
        part, dirs = written = self._write(name, df, state["version"] + 1)
        held = dict(state.get("held", {})) | ({} if dirs is None else {part: dirs})
        return self._publish(name, state | {"appending": True}, [*state["parts"], part], held, T.StructType([*known.fields, *more]), written, check, notes)

    def insert_only(self, name: str, df: DataFrame, keys: list[str]) -> None:
        """Append what the table has no key of."""
        merge.assert_keys(df, keys)
        self.append(name, df.join(self.read(name).select(*keys), keys, "left_anti") if self.exists(name) else df)

    def upsert(self, name: str, df: DataFrame, keys: list[str]) -> None:
        merge.assert_unique(df, keys)
        self.overwrite(name, merge.upsert(self.read(name), df, keys) if self.exists(name) else df)

    def conditional(self, name: str, df: DataFrame, keys: list[str], when: Callable[[str, str], Column]) -> None:
        merge.assert_unique(df, keys)
        self.overwrite(name, merge.conditional(self.read(name), df, keys, when) if self.exists(name) else df)

    def replace_where(self, name: str, df: DataFrame, inside: Column, check: Check | None = None, notes: Notes | None = None) -> None:
        """Rows inside the predicate give way to ``df``, which must lie inside it; ``check`` sees the whole new table.

        Where the table is partitioned and the predicate speaks of its partitions only, just those are written anew;
        partitions inside the predicate for which ``df`` has no rows vanish.
        """
        state = self._pointer(name)
        kept = self._outside(name, state, inside) if state else None
        if kept is None:
            if not df.where(~F.coalesce(inside, F.lit(False))).isEmpty():
                raise merge.MergeError("rows outside the replaced window")
            self.overwrite(name, merge.replace_where(self.read(name), df, inside) if state else df, check, notes)
            return
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        part, dirs = written = self._write(name, df.select(*schema.names), state["version"] + 1)
        if self._matching(schema, {part: dirs}, inside) != {part: dirs}:
            raise merge.MergeError("rows outside the replaced window")
        self._publish(name, state, [*(p for p in state["parts"] if kept.get(p)), part], kept | {part: dirs}, schema, written, check, notes)

    def _outside(self, name: str, state: dict, inside: Column) -> dict[str, list[str]] | None:
        """The partitions that a predicate leaves alone; None if the table is not partitioned or the predicate asks for more than partitions."""
        held, layout = state.get("held", {}), self.layouts.get(name, Layout())
        if not layout.partition_by or set(state["parts"]) - set(held) or state.get("layout", [[]])[0] != list(layout.partition_by):
            return None
        try:
            hit = self._matching(T.StructType.fromJson(json.loads(state["schema"])), held, inside)
        except AnalysisException:
            return None
        return {p: [d for d in dirs if d not in hit.get(p, ())] for p, dirs in held.items()}

    def _matching(self, schema: T.StructType, held: dict[str, list[str]], inside: Column) -> dict[str, list[str]]:
        """Of partitions those for which a predicate over partition columns holds: a row per partition is looked at."""
        rows = []
        for part, dirs in held.items():
            for d in dirs:
                pairs = [level.split("=", 1) for level in d.split("/")]
                rows.append((part, d, [None if v == NO_VALUE else unquote(v) for _, v in pairs], [k for k, _ in pairs]))
        if not rows:
            return {p: [] for p in held}
        names = rows[0][3]
        values = self.spark.createDataFrame([r[:3] for r in rows], "_part string, _dir string, _values array<string>")
        typed = values.select("_part", "_dir", *(F.col("_values")[i].cast(schema[c].dataType).alias(c) for i, c in enumerate(names)))
        hit = {tuple(r) for r in typed.where(F.coalesce(inside, F.lit(False))).select("_part", "_dir").collect()}
        return {p: [d for d in dirs if (p, d) in hit] for p, dirs in held.items()}

    def delete_where(self, name: str, inside: Column) -> None:
        """Rows go; a table that isn't there has none."""
        if self.exists(name):
            self.overwrite(name, self.read(name).where(~F.coalesce(inside, F.lit(False))))

    def add_column(self, name: str, column: str, kind: str) -> None:
        """A null column, unless it is there."""
        now = self.read(name)
        if column not in now.columns:
            self.overwrite(name, now.withColumn(column, F.lit(None).cast(kind)))

    def drop(self, name: str) -> None:
        fs, path = self._fs(self._path(name))
        fs.delete(path, True)

    # -- care ----------------------------------------------------------------

    def detail(self, name: str) -> dict:
        """Files, bytes, average size and whether the table has too many small files."""
        files, size = self._files(name, self._pointer(name) or {"parts": []})
        average = size / files if files else 0.0
        return {"name": name, "files": files, "bytes": size, "avg_mb": round(average / 2**20, 3), "small_files": files > 1 and average < SMALL_FILE}

    def health(self, names: list[str]) -> DataFrame:
        rows = [tuple(self.detail(n).values()) for n in names]
        return self.spark.createDataFrame(rows, "name string, files long, bytes long, avg_mb double, small_files boolean")

    def compact(self, name: str, inside: Column | None = None, z_by: tuple[str, ...] = (), file_bytes: int = 128 * 2**20) -> dict:
        """Rewrite the table, or a window of its partitions, in files of about ``file_bytes``; how many files and bytes went and came.

        With ``z_by`` rows lie along a curve through these columns, so that a filter on any of them meets few files.
        """
        state = self._pointer(name)
        if state is None:
            raise KeyError(name)
        inside = F.lit(True) if inside is None else inside
        kept = self._outside(name, state, inside)
        if kept is None and not state.get("held"):
            kept, chosen = {}, state
        elif kept is None:
            raise merge.MergeError("only windows of whole partitions are compacted")
        else:
            chosen = state | {"held": {p: [d for d in dirs if d not in kept[p]] for p, dirs in state["held"].items()}}
        before = self._files(name, chosen)
        df = self._scan(name, chosen)
        groups = self.layouts.get(name, Layout()).partition_by
        files = max(1, -(-before[1] // file_bytes))
        part = f"v{state['version'] + 1:06d}-{uuid.uuid4().hex[:8]}"
        # No rebalancing here: files are cut where the order says.
        writer = L.along_curve(df, groups, z_by, files).write.mode("overwrite")
        (writer.partitionBy(*groups) if groups else writer).parquet(self._path(name, part))
        dirs = self._partitions(name, part) if groups else None
        held = kept | ({} if dirs is None else {part: dirs})
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        self._publish(name, state, [*(p for p in state["parts"] if kept.get(p)), part], held, schema, (part, dirs), None, None)
        after = self._files(name, {"parts": [part], "held": {} if dirs is None else {part: dirs}})
        return {"files_before": before[0], "bytes_before": before[1], "files_after": after[0], "bytes_after": after[1]}

    def _files(self, name: str, found: dict) -> tuple[int, int]:
        """Parquet files and bytes of a version."""
        count = size = 0
        for part in found["parts"]:
            for d in found.get("held", {}).get(part, [""]):
                fs, path = self._fs(self._path(name, part, d).rstrip("/"))
                files = fs.listFiles(path, True)
                while files.hasNext():
                    f = files.next()
                    if f.getPath().getName().endswith(".parquet"):
                        count, size = count + 1, size + f.getLen()
        return count, size

    def apply_layout(self, name: str, layout: Layout) -> bool:
        """Rewrite if the table lies otherwise; whether it did."""
        self.layouts[name] = layout
        state = self._pointer(name)
        wanted = [list(layout.partition_by), list(layout.cluster_by)]
        if state is None or state.get("layout", [[], []]) == wanted:
            return False
        self.overwrite(name, self.read(name))
        return True

    def vacuum(self, name: str, keep: tuple[int, ...] = ()) -> int:
        """Delete folders that neither the table nor one of the versions to ``keep`` reads; how many.  Only while nobody writes."""
        state, gone = self._pointer(name), 0
        read = {p for found in (state, *(self._at(state, v) for v in keep)) if found for p in found["parts"]} if state else set()
        fs, path = self._fs(self._path(name))
        for status in fs.listStatus(path) if state else ():
            label = status.getPath().getName()
            if label.startswith("v") and label not in read:
                fs.delete(status.getPath(), True)
                gone += 1
        return gone

    def set_properties(self, name: str, properties: dict[str, str]) -> None:
        state = self._pointer(name)
        if state is None:
            raise KeyError(name)
        self._point(name, {"rows_version": state["version"]} | state | {"version": state["version"] + 1, "properties": state["properties"] | properties})

    def describe(self, name: str, columns: dict[str, dict]) -> None:
        """Add metadata to columns; readers find it in the schema."""
        state = self._pointer(name)
        if state is None:
            raise KeyError(name)
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        fields = [T.StructField(f.name, f.dataType, f.nullable, f.metadata | columns.get(f.name, {})) for f in schema.fields]
        if fields != schema.fields:
            self._point(name, {"rows_version": state["version"]} | state | {"version": state["version"] + 1, "schema": T.StructType(fields).json()})

    def properties(self, name: str) -> dict[str, str]:
        return (self._pointer(name) or {}).get("properties", {})


def _stored(schema: T.StructType) -> T.StructType:
    """As Parquet gives it back: everything may be null."""
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields])

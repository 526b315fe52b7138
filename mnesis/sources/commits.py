"""Tables under one commit log: what a write changes in several tables becomes visible at once or not at all, and any version can be read again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: So many updates are kept beside a table before one rewrites it.
LAYERS = 8


class Conflict(RuntimeError):
    """Another writer has changed what this write was made from."""


class Damaged(RuntimeError):
    """A copy doesn't hold what its commit says."""


@dataclass(frozen=True)
class Change:
    """append: rows that are new; upsert: rows that take the place of those with their key; update: keys and what some columns now hold, where the key is there (of several rows
    for a key one is taken); delete: keys whose rows go; replace: rows that are the whole table from now on."""

    kind: str
    rows: DataFrame


class Store:
    """Parquet tables below `root`, each in buckets by a hash of its key, and `_log`, a file for each version that lists the directories of every table's buckets.

    A write puts its files into directories of its own, rewriting only the buckets in which it changes rows, and then creates the log's next file, which must not exist:
    of two writers one succeeds. The loser goes on if both only appended, or changed other tables; else it is a Conflict. Files that no version lists are of no effect.
    An update rewrites no bucket: its keys and columns are a layer, which reading joins by key, with no more columns than are asked for; LAYERS of them are folded into the table by
    the next one.
    Creating a file that must not exist is atomic where the file system says so, as HDFS does.
    A commit may bear a mark, a stream's name and a batch's number: one whose stream is that far already is of no effect, so that a batch that is repeated counts once.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    # the log

    def versions(self) -> list[int]:
        log = self._path(f"{self.root}/_log")
        if not self._fs.exists(log):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(log) if s.getPath().getName().endswith(".json"))

    def version(self) -> int:
        """The last version; -1 before the first."""
        return max(self.versions(), default=-1)

    def entry(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if v < 0:
            return {"version": -1, "op": None, "tables": {}}
        text = self.spark.read.text(f"{self.root}/_log/{v:020d}.json", wholetext=True).first()
        return json.loads(text.value)

    def _put(self, entry: dict) -> bool:
        try:
            out = self._fs.create(self._path(f"{self.root}/_log/{entry['version']:020d}.json"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        out.write(json.dumps(entry).encode())
        out.close()
        return True

    # tables

    def create(self, name: str, rows: DataFrame, key: str | None, buckets: int = 16) -> int:
        """A new table of these rows. Without a key it can only be appended to."""
        base = self.entry()
        if name in base["tables"]:
            raise ValueError(f"table {name} is there")
        spec = {"key": key, "buckets": buckets if key else 1, "schema": rows.schema.jsonValue(), "dirs": {}, "layers": []}
        base["tables"][name] = spec
        return self._commit(base, "create", {name: Change("append", rows)}, {name})

    def read(self, name: str, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        spec = self.entry(version)["tables"][name]
        return self._rows(spec, buckets)

    def _rows(self, spec: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(spec["schema"])
        wanted = spec["dirs"] if buckets is None else [str(b) for b in buckets if str(b) in spec["dirs"]]
        dirs = [f"{self.root}/{d}" for b in wanted for d in spec["dirs"][b]]
        rows = self.spark.read.schema(schema).parquet(*dirs) if dirs else self.spark.createDataFrame([], schema)
        for layer in spec.get("layers", ()):
            parts = [f"{self.root}/{layer['dirs'][b]}" for b in wanted if b in layer["dirs"]]
            if parts:
                rows = _over(rows, self.spark.read.schema(StructType.fromJson(layer["schema"])).parquet(*parts), spec["key"])
        return rows

    def _bucket(self, spec: dict) -> Column:
        return F.pmod(F.xxhash64(spec["key"]), F.lit(spec["buckets"])).cast("int") if spec["key"] else F.lit(0)

    def _write(self, name: str, spec: dict, change: Change) -> dict:
        """The table's directories and layers after the change, whose files are written here."""
        own, schema = f"data/{name}/{uuid.uuid4().hex}", StructType.fromJson(spec["schema"])
        bucket = free(schema.fieldNames())
        touched, layer = None, None
        if change.kind == "replace":
            touched, rows = list(spec["dirs"]), change.rows.select(*schema.fieldNames())
        elif change.kind == "append":
            rows = change.rows.select(*schema.fieldNames())
        elif not spec["key"]:
            raise ValueError(f"table {name} has no key")
        elif change.kind == "update":
            part = StructType([schema[spec["key"]], *(schema[c] for c in change.rows.columns if c != spec["key"])])
            rows = change.rows.select(*[F.col(f"`{x.name}`").cast(x.dataType).alias(x.name) for x in part]).dropDuplicates([spec["key"]])
            if len(spec.get("layers", ())) < LAYERS:
                # keys that aren't there are left out, so that a row which comes later with such a key is as it comes
                layer, rows = part, rows.join(self._rows(spec | {"layers": []}).select(spec["key"]), spec["key"], "left_semi")
            else:
                touched, rows = list(spec["dirs"]), _over(self._rows(spec), rows, spec["key"])
        else:
            keys = change.rows.select(spec["key"])
            touched = [r.b for r in keys.select(self._bucket(spec).alias("b")).distinct().collect()]  # no more than there are buckets
            rows = self._rows(spec, touched).join(keys.withColumnRenamed(spec["key"], "_key").distinct(), F.col(spec["key"]) == F.col("_key"), "left_anti")
            if change.kind == "upsert":
                rows = rows.unionByName(change.rows.select(*schema.fieldNames()))
        rows.withColumn(bucket, self._bucket(spec)).hint("rebalance", bucket).write.partitionBy(bucket).parquet(f"{self.root}/{own}")
        new = {}
        for s in self._fs.listStatus(self._path(f"{self.root}/{own}")):
            if s.isDirectory():
                new[s.getPath().getName().split("=")[1]] = f"{own}/{s.getPath().getName()}"
        dirs, layers = {b: list(d) for b, d in spec["dirs"].items()}, list(spec.get("layers", ()))
        if layer is not None:
            return {"dirs": dirs, "layers": [*layers, {"schema": layer.jsonValue(), "dirs": new}] if new else layers}
        gone = {str(b) for b in touched or ()}
        for b in gone:
            dirs.pop(b, None)
        for b, d in new.items():
            dirs[b] = [*dirs.get(b, []), d]
        left = [x | {"dirs": {b: d for b, d in x["dirs"].items() if b not in gone}} for x in layers]
        return {"dirs": dirs, "layers": [x for x in left if x["dirs"]]}

    def commit(self, op: str, changes: dict[str, Change], base: int | None = None, mark: tuple[str, int] | None = None) -> int:
        """Make the changes, which were derived from version `base` (the last, if none is said), the next version; its number, or with a mark that is there already the
        version's that has it."""
        return self._commit(self.entry(base), op, changes, set(), mark)

    def marks(self, version: int | None = None) -> dict[str, int]:
        """The last batch of each stream."""
        return self.entry(version).get("marks", {})

    def _commit(self, base: dict, op: str, changes: dict[str, Change], made: set[str], mark: tuple[str, int] | None = None) -> int:
        own = dict([mark] if mark else [])
        past = lambda entry: any(entry.get("marks", {}).get(k, -1) >= n for k, n in own.items())
        if past(base):
            return base["version"]
        written = {name: self._write(name, base["tables"][name], change) for name, change in changes.items()}
        added = {n: {b: [d for d in dirs if d not in base["tables"][n]["dirs"].get(b, [])] for b, dirs in x["dirs"].items()} for n, x in written.items()}
        entry = {"version": base["version"] + 1, "op": op, "tables": {**base["tables"], **{n: base["tables"][n] | x for n, x in written.items()}}, "kinds": {n: c.kind for n, c in changes.items()}, "marks": base.get("marks", {}) | own}
        while not self._put(entry):
            other = self.entry(entry["version"])
            if past(other):
                return other["version"]
            for name, change in changes.items():
                kind = other["kinds"].get(name)
                if name in made or (kind is not None and (kind != "append" or change.kind != "append")):
                    raise Conflict(f"{name} was changed by {other['op']} in version {other['version']}")
            tables = dict(other["tables"])
            for name, change in changes.items():  # the other's table, where both appended, has its rows and ours
                theirs = other["tables"][name]["dirs"]
                both = {b: [*theirs.get(b, []), *added[name].get(b, [])] for b in {*theirs, *added[name]}}
                tables[name] = other["tables"][name] | ({"dirs": both} if change.kind == "append" else written[name])
            entry = entry | {"version": other["version"] + 1, "tables": tables, "marks": other.get("marks", {}) | own}
        return entry["version"]

    # copies

    def counts(self, version: int | None = None) -> DataFrame:
        """name, n_rows and checksum of every table at one version."""
        return _counts({name: self._rows(spec) for name, spec in sorted(self.entry(version)["tables"].items())})

    def snapshot(self, path: str, version: int | None = None) -> None:
        """Copy all tables as they were at one version, with their counts; the counts come last, so that what is torn has none."""
        entry = self.entry(version)
        for name, spec in entry["tables"].items():
            self._rows(spec).write.mode("overwrite").parquet(f"{path}/tables/{name}")
        self.spark.createDataFrame([(k, n) for k, n in entry.get("marks", {}).items()], "stream string, batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/marks")
        self.spark.createDataFrame([(n, json.dumps(s | {"dirs": {}, "layers": []})) for n, s in entry["tables"].items()], "name string, spec string").coalesce(1).write.mode("overwrite").parquet(f"{path}/specs")
        self.counts(entry["version"]).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")

    def restore(self, path: str) -> DataFrame:
        """Fill this empty store from a copy; name, n_rows and checksum of what is there now. A copy without counts, or with others than it holds, is Damaged."""
        if self.version() >= 0:
            raise ValueError("the store isn't empty")
        if not self._fs.exists(self._path(f"{path}/counts/_SUCCESS")):
            raise Damaged("the copy was never finished")
        specs = {r.name: json.loads(r.spec) for r in self.spark.read.parquet(f"{path}/specs").collect()}
        rows = {n: self.spark.read.schema(StructType.fromJson(s["schema"])).parquet(f"{path}/tables/{n}") for n, s in specs.items()}
        said = self.spark.read.parquet(f"{path}/counts")
        if not said.exceptAll(_counts(rows)).isEmpty():
            raise Damaged("tables differ from the copy's counts")
        marks = {r.stream: r.batch for r in self.spark.read.parquet(f"{path}/marks").collect()}
        base = {"version": -1, "op": None, "tables": specs, "marks": marks}
        self._commit(base, "restore", {n: Change("append", r) for n, r in rows.items()}, set(specs))
        return self.counts()

    def vacuum(self, keep: int) -> int:
        """Delete the data directories that none of the last `keep` versions lists, and the older versions; how many directories went. No writer may be at work."""
        kept = self.versions()[-keep:]
        tables = [s for v in kept for s in self.entry(v)["tables"].values()]
        used = {d for s in tables for x in s["dirs"].values() for d in x} | {d for s in tables for x in s.get("layers", ()) for d in x["dirs"].values()}
        gone = 0
        for table in self._list("data"):
            for own in self._list(f"data/{table}"):
                for part in self._list(f"data/{table}/{own}"):
                    if part.startswith("_") or f"data/{table}/{own}/{part}" in used:
                        continue
                    gone += self._fs.delete(self._path(f"{self.root}/data/{table}/{own}/{part}"), True)
        for v in self.versions()[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_log/{v:020d}.json"), False)
        return gone

    def _list(self, path: str) -> list[str]:
        where = self._path(f"{self.root}/{path}")
        return [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []


def free(taken: list[str]) -> str:
    name = "bucket"
    while name in taken:
        name += "_"
    return name


def _over(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of `new` where it has their key. Columns that nobody asks for are read from neither."""
    named = new.select(F.col(f"`{key}`").alias("_key"), *[F.col(f"`{c}`").alias(f"_new_{c}") for c in new.columns if c != key])
    there = F.col("_key").isNotNull()
    columns = [F.when(there, F.col(f"`_new_{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c != key and c in new.columns else F.col(f"`{c}`") for c in rows.columns]
    return rows.join(named, F.col(f"`{key}`") == F.col("_key"), "left").select(*columns)


def _counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and a checksum that doesn't depend on their order: the sum of their hashes. Maps have none, and count as text."""
    parts = []
    for name, df in tables.items():
        row = F.xxhash64(*[F.col(f"`{c}`") if not t.startswith("map") else F.to_json(F.col(f"`{c}`")) for c, t in df.dtypes])
        parts.append(df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

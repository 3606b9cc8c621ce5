"""A keyed table in hash buckets: a merge rewrites only the buckets its keys fall in.

Under ``root``, ``data/<version>/bucket=<b>`` holds what one commit wrote of a bucket, and ``pointers/<n>.json`` names for each
bucket the version its rows are to be read from. A commit writes its buckets beside those in use and then its pointers, renamed into
place; until then readers go on with the commit before, so a failed run changes nothing. Files are never altered. Any number may
read, one writes at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclake.operators.current import upsert
from civiclake.session import materialise

BUCKETS = 64
Resolve = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Commit:
    """The version of each bucket, the columns its files have, and those of the whole table."""

    number: int
    buckets: int
    schema: T.StructType
    at: dict[int, tuple[str, T.StructType]]


class BucketedTable:
    """``buckets`` is fixed by the first commit: choose it so that one bucket is a few hundred megabytes."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), list(keys), buckets

    def _folder(self, path: str):
        """A path and its file system, by the session's own settings."""
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return found, found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        found, files = self._folder(pattern)
        return [m.getPath().getName() for m in files.globStatus(found) or []]

    def commits(self) -> list[int]:
        """Complete commits, oldest first."""
        return sorted(int(name.removesuffix(".json")) for name in self._names("pointers/[0-9]*.json"))

    def commit(self, before: int | None = None) -> Commit | None:
        """The newest commit (older than ``before``)."""
        numbers = [n for n in self.commits() if before is None or n < before]
        if not numbers:
            return None
        path, files = self._folder(f"pointers/{numbers[-1]}.json")
        stream = files.open(path)
        try:
            content = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        schemas = {v: T.StructType.fromJson(columns) for v, columns in content["versions"].items()}
        at = {int(b): (v, schemas[v]) for b, v in content["at"].items()}
        return Commit(numbers[-1], content["buckets"], T.StructType.fromJson(content["columns"]), at)

    def _point(self, commit: Commit) -> None:
        """Writes a commit's pointers under another name and renames them: they are there whole or not at all."""
        content = {"buckets": commit.buckets, "columns": commit.schema.jsonValue(), "at": {str(b): v for b, (v, _) in commit.at.items()},
                   "versions": {v: columns.jsonValue() for v, columns in commit.at.values()}}
        path, files = self._folder(f"pointers/{commit.number}.json")
        beside, _ = self._folder(f"pointers/_{commit.number}-{uuid.uuid4().hex}")
        stream = files.create(beside)
        try:
            stream.write(json.dumps(content).encode())
        finally:
            stream.close()
        files.delete(path, False)
        if not files.rename(beside, path):
            raise RuntimeError(f"commit {commit.number} of {self.root} could not be put in place")

    def bucket(self, schema: T.StructType, buckets: int) -> Column:
        """A row's bucket; keys are taken in the table's types, so equal keys of another width meet."""
        return F.pmod(F.xxhash64(*[F.col(k).cast(schema[k].dataType) for k in self.keys]), F.lit(buckets)).cast("int")

    def paths(self, commit: Commit, only: Sequence[int] | None = None) -> list[str]:
        return [f"{self.root}/data/{v}/bucket={b}" for b, (v, _) in sorted(commit.at.items()) if only is None or b in only]

    def read(self, commit: Commit | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The rows of the newest commit, or of the one given; of some buckets only, if named."""
        commit = commit or self.commit()
        if commit is None:
            raise ValueError(f"no version in {self.root}")
        paths = self.paths(commit, only)
        return self.spark.read.schema(commit.schema).parquet(*paths) if paths else self.spark.createDataFrame([], commit.schema)

    def merge(self, source: DataFrame, resolve: Resolve | None = None, number: int | None = None) -> list[int]:
        """Merges ``source`` by key and returns the buckets written anew.

        ``resolve`` makes the new rows of the touched buckets from the old and the incoming ones, by default an upsert that refuses
        a key given twice. ``number`` names the commit (a micro-batch); the same number again starts from the commit before it.
        Without one the next is taken.
        """
        before = self.commit(number)
        number = number if number is not None else 0 if before is None else before.number + 1
        version = f"v{number}-{uuid.uuid4().hex}"
        schema = before.schema if before else source.schema
        buckets = before.buckets if before else self.buckets
        at = dict(before.at) if before else {}
        seen = Observation()
        keyed = source.withColumn("_bucket", self.bucket(schema, buckets)).observe(seen, F.collect_set("_bucket").alias("touched"))
        incoming = materialise(keyed, "incoming").drop("_bucket")
        touched = sorted(seen.get["touched"])  # at most one a bucket
        resolve = resolve or (lambda old, new: upsert(old, new, self.keys))
        merged = resolve(self.read(before, touched) if before else incoming.limit(0), incoming)
        merged = merged.select(*[F.col(f.name).cast(schema[f.name].dataType).alias(f.name) if f.name in schema.names else F.col(f.name) for f in merged.schema])
        columns = T.StructType([T.StructField(f.name, f.dataType) for f in merged.schema])
        if touched:
            placed = merged.withColumn("bucket", self.bucket(schema, buckets)).hint("rebalance", "bucket")
            placed.write.partitionBy("bucket").parquet(f"{self.root}/data/{version}")
        self._point(Commit(number, buckets, columns, at | {b: (version, columns) for b in touched}))
        return touched

    def as_sql(self) -> str:
        """A SELECT over the files of the newest commit, for a view."""
        commit = self.commit()
        if commit is None:
            raise ValueError(f"no version in {self.root}")
        groups: dict[tuple[str, str], list[int]] = {}
        for b, (v, columns) in commit.at.items():
            groups.setdefault((v, columns.json()), []).append(b)
        parts = []
        for (v, columns), members in sorted(groups.items()):
            known = T.StructType.fromJson(json.loads(columns)).names
            chosen = [f"`{f.name}`" if f.name in known else f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in commit.schema]
            folders = ",".join(str(b) for b in sorted(members))
            parts.append(f"SELECT {', '.join(chosen)} FROM parquet.`{self.root}/data/{v}/bucket={{{folders}}}`")
        none = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in commit.schema)
        return " UNION ALL ".join(parts) or f"SELECT {none} WHERE false"

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes files that none of the newest ``keep`` commits reads, and the pointers of the others. Returns what went."""
        numbers = self.commits()
        kept = numbers[-keep:]
        used = {path for n in kept for path in self.paths(self.commit(n + 1))}
        gone = [f"pointers/{n}.json" for n in numbers if n not in kept]
        for v in self._names("data/v*"):
            if int(v[1:].partition("-")[0]) <= numbers[-1]:  # a later one is being written
                gone += [p for b in self._names(f"data/{v}/bucket=*") if f"{self.root}/{(p := f'data/{v}/{b}')}" not in used]
        for name in gone:
            path, files = self._folder(name)
            files.delete(path, True)
        return gone

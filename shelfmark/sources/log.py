"""Keyed tables kept as logs: a version writes what it changes, and the newest record of a key counts.

A log is a folder of versions `v=<number>`.  A version holds, for each table, the rows it changed
and the keys that are gone, dealt over buckets by the hash of one key column.  Its marker
`_COMPLETE`, which is written last, is its manifest: which runs of which versions make up each bucket.  So
a version that dies leaves the one before it current, and one written again replaces itself.

Where a bucket's earlier runs are no larger than those after them, they are merged when it is written
to: run sizes of a bucket shrink from one to the next, so it has few runs, a row is rewritten
some log2 (table / batch) times, and what a version writes follows what it changes, not
what the table holds.

Reading takes the newest row of each key in the buckets asked for.  With `of`, the keys of a
batch say which buckets those are; the list of buckets is all that comes to the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

AT, GONE, BUCKET = "_at", "_gone", "in_bucket"
# Of a new log, unless the session sets `shelfmark.log.buckets`: for a billion rows take some thousands.
BUCKETS = 16
_MARKER = "_COMPLETE"
# A run: (version, merged, bytes).
Run = tuple[int, bool, int]


@dataclass(frozen=True)
class Table:
    """`schema` as DDL; one row per `keys`, dealt by the hash of column `by` (the first key)."""

    schema: str
    keys: tuple[str, ...]
    by: str | None = None

    @property
    def dealt_by(self) -> str:
        return self.by or self.keys[0]


def merged_from(runs: list[Run]) -> int:
    """The first of the last runs that are to be one: earlier ones no larger than all after them."""
    first, size = len(runs) - 1, runs[-1][2]
    while first and runs[first - 1][2] <= size:
        first -= 1
        size += runs[first][2]
    return first


class Log:
    """`buckets` counts for a new log; one that exists keeps its own."""

    def __init__(self, spark: SparkSession, folder: str, tables: Mapping[str, Table], buckets: int | None = None, prefix: str = "v"):
        self.spark, self.folder, self.tables, self.prefix = spark, folder.rstrip("/"), dict(tables), prefix
        self._buckets = buckets or int(spark.conf.get("shelfmark.log.buckets", str(BUCKETS)))

    # Files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *(p for p in parts if p)]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _version(self, version: int) -> str:
        return f"{self.prefix}={version}"

    def _run_folder(self, name: str, run: Run) -> str:
        version, merged, _ = run
        inner = [p for p in (["_merged", name, self._version(version)] if merged else [self._version(version), name]) if p]
        return "/".join([self.folder, *inner])

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        files = self._files()
        if not files.exists(self._path()):
            return []
        found = []
        for entry in files.listStatus(self._path()):
            name = entry.getPath().getName()
            if name.startswith(f"{self.prefix}=") and files.exists(self._path(name, _MARKER)):
                found.append(int(name.partition("=")[2]))
        return sorted(found)

    def _manifest(self, version: int) -> dict:
        stream = self._files().open(self._path(self._version(version), _MARKER))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _mark(self, version: int, manifest: dict) -> None:
        out = self._files().create(self._path(self._version(version), _MARKER), True)
        try:
            out.write(bytearray(json.dumps(manifest, separators=(",", ":")).encode()))
        finally:
            out.close()

    def _known(self, version: int | None, below: int | None = None) -> dict:
        """The manifest of `version`, or of the newest one there is (below `below`)."""
        known = [v for v in self.versions() if below is None or v < below]
        if version is not None and version not in known:
            raise ValueError(f"no version {version} in {self.folder}")
        if not known:
            return {"buckets": self._buckets, "tables": {}}
        return self._manifest(known[-1] if version is None else version)

    # Reading

    def _runs(self, manifest: dict, name: str) -> dict[int, list[Run]]:
        return {int(b): [(v, bool(m), n) for v, m, n in runs] for b, runs in manifest["tables"].get(name, {}).items()}

    def _bucket(self, name: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.tables[name].dealt_by), F.lit(buckets)).cast("int")

    def _rows(self, name: str, runs: Mapping[int, Iterable[Run]]) -> DataFrame:
        """Rows of the runs given for each bucket, with their version and whether they are gone."""
        schema = StructType.fromDDL(f"{self.tables[name].schema}, {AT} bigint, {GONE} boolean")
        folders = [f"{self._run_folder(name, run)}/{BUCKET}={bucket}" for bucket, some in runs.items() for run in some]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _newest(self, rows: DataFrame, name: str) -> DataFrame:
        keys = list(self.tables[name].keys)
        rest = [c for c in rows.columns if c not in keys]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), AT).alias("_row"))
        return newest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])

    def read(self, name: str, version: int | None = None, of: DataFrame | None = None, with_version: bool = False) -> DataFrame:
        """The table as of a version, the last by default; empty before the first.

        `of` holds the column the table is dealt by: only rows of its values are read and given.
        """
        rows = self._current(name, version, of).where(f"not {GONE}")
        return rows.select(*StructType.fromDDL(self.tables[name].schema).names, *([AT] if with_version else []))

    def _current(self, name: str, version: int | None, of: DataFrame | None) -> DataFrame:
        """The newest row of each key, also where that tells that the key is gone."""
        manifest, by = self._known(version), self.tables[name].dealt_by
        runs = self._runs(manifest, name)
        if of is not None:
            of = of.select(by).where(F.col(by).isNotNull()).distinct()
            # At most as many numbers as there are buckets.
            touched = {r[0] for r in of.select(self._bucket(name, manifest["buckets"])).distinct().collect()}
            runs = {b: r for b, r in runs.items() if b in touched}
        one = self._rows(name, {b: r for b, r in runs.items() if len(r) == 1})
        more = self._rows(name, {b: r for b, r in runs.items() if len(r) > 1})
        if of is not None:
            one, more = one.join(of, by, "left_semi"), more.join(of, by, "left_semi")
        return one.unionByName(self._newest(more, name)) if any(len(r) > 1 for r in runs.values()) else one

    def newest(self, at_most: int) -> int | None:
        """The newest version up to `at_most`."""
        return max((v for v in self.versions() if v <= at_most), default=None)

    def since(self, name: str, after: int, upto: int) -> DataFrame:
        """What the versions after `after` up to `upto` wrote, the newest of each key, with its version."""
        folders = [self._run_folder(name, (v, False, 0)) for v in self.versions() if after < v <= upto]
        schema = StructType.fromDDL(f"{self.tables[name].schema}, {AT} bigint, {GONE} boolean")
        rows = [self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f) for f in folders if self._files().exists(self.spark._jvm.org.apache.hadoop.fs.Path(f))]
        found = reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], schema)
        return self._newest(found, name).where(f"not {GONE}").drop(GONE)

    # Writing

    def write(
        self, version: int, changes: Mapping[str, DataFrame], gone: Mapping[str, DataFrame] | None = None,
        whole: bool = False, before: bool = False,
    ) -> None:
        """Write a version on top of the newest below it: rows of `changes` replace those of their
        keys (one row to a key), keys of `gone` go.  With `whole` nothing older counts.  With
        `before`, rows as they were are kept beside it, for `reverted`."""
        gone = gone or {}
        earlier = self._known(None, below=version)
        known = {"buckets": earlier["buckets"], "tables": {}} if whole else earlier
        self._files().delete(self._path(self._version(version), _MARKER), False)
        tables = {}
        for name in self.tables:
            runs = self._runs(known, name)
            if name in changes or name in gone:
                runs = self._written(name, version, changes.get(name), gone.get(name), runs, known["buckets"], before)
            tables[name] = {str(b): r for b, r in runs.items()}
        self._mark(version, {"buckets": known["buckets"], "tables": tables})

    def _written(
        self, name: str, version: int, changes: DataFrame | None, gone: DataFrame | None, runs: dict[int, list[Run]], buckets: int, before: bool
    ) -> dict[int, list[Run]]:
        schema = StructType.fromDDL(self.tables[name].schema)
        parts = []
        for frame, is_gone in ((changes, False), (gone, True)):
            if frame is not None:
                parts.append(frame.select(
                    *[(F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema],
                    F.lit(version).cast("bigint").alias(AT), F.lit(is_gone).alias(GONE),
                ))
        fresh = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
        target = self._run_folder(name, (version, False, 0))
        self._write(fresh, name, buckets, target)
        sizes = self._sizes(target)
        if before:
            schema_before = f"{self.tables[name].schema}, {BUCKET} int"
            keys = self.spark.read.schema(schema_before).parquet(target).select(*self.tables[name].keys)
            prior = self._newest(self._rows(name, {b: runs[b] for b in sizes if b in runs}), name).where(f"not {GONE}")
            prior.join(keys, list(self.tables[name].keys), "left_semi").write.mode("overwrite").parquet(self._before(name, version))
        runs = dict(runs)
        merging: dict[int, list[Run]] = {}
        for bucket, size in sizes.items():
            mine = [*runs.get(bucket, []), (version, False, size)]
            first = merged_from(mine)
            if first < len(mine) - 1:
                merging[bucket] = mine[first:]
            runs[bucket] = mine
        if merging:
            # What is gone need not be told where nothing older is left.
            bottom = [b for b, some in merging.items() if len(some) == len(runs[b])]
            kept = self._newest(self._rows(name, merging), name)
            if bottom:
                kept = kept.where(~F.col(GONE) | ~self._bucket(name, buckets).isin(bottom))
            place = (version, True, 0)
            self._write(kept, name, buckets, self._run_folder(name, place))
            left = self._sizes(self._run_folder(name, place))
            for bucket, some in merging.items():
                whole = runs[bucket][: len(runs[bucket]) - len(some)]
                runs[bucket] = [*whole, (version, True, left[bucket])] if bucket in left else whole
        return {b: r for b, r in runs.items() if r}

    def _sizes(self, target: str) -> dict[int, int]:
        """Bytes of each bucket that has any."""
        files, place = self._files(), self.spark._jvm.org.apache.hadoop.fs.Path(target)
        entries = files.listStatus(place) if files.exists(place) else []
        named = [(e.getPath().getName(), e.getPath()) for e in entries]
        return {int(n.partition("=")[2]): files.getContentSummary(p).getLength() for n, p in named if n.startswith(f"{BUCKET}=")}

    def _write(self, rows: DataFrame, name: str, buckets: int, target: str) -> None:
        dealt = rows.withColumn(BUCKET, self._bucket(name, buckets))
        # A bucket is one file; keys are alike in number, so buckets are alike in size.
        dealt.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(target)

    # Going back

    def _before(self, name: str, version: int) -> str:
        return "/".join(p for p in (self.folder, "_before", name, self._version(version)) if p)

    def reverted(self, name: str, written: int, keys: DataFrame, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(changes, gone) that take `keys` back to what they were before version `written`,
        which kept that (`before`); keys that a later version has written stay as they are."""
        table = self.tables[name]
        on = list(table.keys)
        current = self._current(name, version, keys)
        later = current.where(F.col(AT) != written).select(*on)
        mine = keys.select(*on).distinct().join(later, on, "left_anti")
        there = current.where((F.col(AT) == written) & ~F.col(GONE)).select(*on)
        if not self._files().exists(self.spark._jvm.org.apache.hadoop.fs.Path(self._before(name, written))):
            return self.spark.createDataFrame([], table.schema), mine.join(there, on, "left_semi")
        prior = self.spark.read.schema(table.schema).parquet(self._before(name, written))
        return prior.join(mine, on, "left_semi"), mine.join(there, on, "left_semi").join(prior.select(*on), on, "left_anti")

    def drop(self, keep: int) -> None:
        """Forget all but the newest `keep` versions, and the runs that only those before need."""
        files, known = self._files(), self.versions()
        old, kept = known[:-keep], known[-keep:]
        if not old:
            return
        held = lambda versions: {
            (name, int(b), (v, bool(m))) for version in versions for name, runs in self._manifest(version)["tables"].items() for b, some in runs.items() for v, m, _ in some
        }
        unused = held(old) - held(kept)
        for version in old:
            files.delete(self._path(self._version(version), _MARKER), False)
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for name, bucket, run in unused:
            files.delete(hadoop(f"{self._run_folder(name, (*run, 0))}/{BUCKET}={bucket}"), True)

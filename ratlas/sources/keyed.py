"""A table with a key that is changed by commits: files by ranges of the key, deltas merged on read, ranges compacted.

A commit writes what changes, in folders by range, and then one manifest, which names all files that belong to the table.
Until the manifest is there the table is as it was; files that no manifest names are as good as not written. Readers take
the latest manifest, so they see whole commits only. A batch rewrites nothing: what it brings lies beside the range's
base until so many deltas have gathered that the range, and no other, is written anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ratlas import schemas
from ratlas.sources.shared import path_of

#: Ranges of a new table, deltas of a range before it is compacted, and manifests that vacuum() keeps.
RANGES, MOST_DELTAS, KEPT = 16, 4, 2


class Conflict(Exception):
    """Another writer has committed since the manifest was read."""


@dataclass(frozen=True)
class KeyedTable:
    """The table below path. schema is its DDL; rows that share a key belong together and are replaced together.

    Columns __gone (a key that was deleted), __range and those of schema lie in the files. A manifest is a small JSON file:
    the bounds of the ranges; of each range its base and its deltas in order; and the last batch of each writer.
    """

    spark: SparkSession
    path: str
    schema: str
    key: str

    # manifests

    def _versions(self) -> list[int]:
        fs, where = path_of(self.spark, f"{self.path}/versions")
        if not fs.exists(where):
            return []
        return sorted(int(x.getPath().getName()[:-5]) for x in fs.listStatus(where) if x.getPath().getName().endswith(".json"))

    def _manifest(self, version: int) -> dict | None:
        """A manifest; None if its writer died before it was whole."""
        text = self.spark.read.text(f"{self.path}/versions/{version:012d}.json", wholetext=True).first()
        try:
            return json.loads(text[0])
        except (TypeError, ValueError):
            return None

    def current(self) -> dict:
        """The latest whole manifest; of a table that has none, an empty one of version 0."""
        versions = self._versions()
        for v in reversed(versions):
            if found := self._manifest(v):
                return found
        return {"version": 0, "bounds": None, "ranges": {}, "batches": {}}

    def _commit(self, manifest: dict, base: dict) -> dict:
        """Puts a manifest in place as the next version, unless another has come since base was read."""
        if self.current()["version"] != base["version"]:
            raise Conflict(f"version {base['version']} is no longer the latest")
        version = max([base["version"], *self._versions()]) + 1
        fs, where = path_of(self.spark, f"{self.path}/versions/{version:012d}.json")
        try:
            out = fs.create(where, False)  # fails where the file exists: only one of several writers gets a version
        except Exception as e:
            raise Conflict(f"version {version} was taken") from e
        out.write(json.dumps({**manifest, "version": version}).encode())
        out.close()
        return {**manifest, "version": version}

    # files

    def _range(self, bounds: Sequence) -> Column:
        """The number of bounds that a key reaches; null is below all."""
        kind = StructType.fromDDL(self.schema)[self.key].dataType
        if not bounds:
            return F.lit(0)
        held = F.array(*[F.lit(b).cast(kind) for b in bounds])
        return F.when(F.col(self.key).isNull(), 0).otherwise(F.size(F.filter(held, lambda b: b <= F.col(self.key))))

    def _bounds(self, rows: DataFrame, ranges: int) -> list[str]:
        """The smallest keys of the ranges that Spark's own sampling cuts, as text; one number a range comes here."""
        dealt = rows.select(self.key).where(F.col(self.key).isNotNull()).repartitionByRange(ranges, self.key)
        lows = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(self.key).alias("low")).orderBy("low").select(F.col("low").cast("string")).collect()
        return [r[0] for r in lows][1:]

    def _write(self, rows: DataFrame, bounds: Sequence) -> tuple[str, list[str]]:
        """Writes rows (schema and __gone) to a folder of its own: its name, and the ranges it has."""
        name = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("__range", self._range(bounds)).repartitionByRange("__range", self.key)
        dealt.write.partitionBy("__range").parquet(f"{self.path}/{name}")
        fs, where = path_of(self.spark, f"{self.path}/{name}")
        found = [x.getPath().getName() for x in fs.listStatus(where)]
        return name, sorted(x.partition("=")[2] for x in found if x.startswith("__range="))

    def _read(self, name: str, ranges: Sequence[str]) -> DataFrame:
        schema = StructType.fromDDL(self.schema).add("__gone", "boolean").add("__range", "integer")
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/__range={r}" for r in ranges])

    # reading

    def _merged(self, ranges: dict[str, dict]) -> DataFrame:
        """The rows of ranges: of each key those of its latest delta, else those of the base. Keys of deltas are gathered
        first, so that the base is read once and only left out from."""
        columns = [f.name for f in StructType.fromDDL(self.schema)]
        bases, deltas, order = {}, {}, {}
        for r, files in ranges.items():
            if files["base"]:
                bases.setdefault(files["base"], []).append(r)
            for place, name in files["deltas"]:
                deltas.setdefault(name, []).append(r)
                order[name] = place
        union = lambda parts: reduce(DataFrame.unionByName, parts)
        base = union([self._read(n, r).where(~F.col("__gone")) for n, r in bases.items()]) if bases else None
        if not deltas:
            return base.select(*columns) if base is not None else schemas.empty(self.spark, self.schema)
        new = union([self._read(n, r).withColumn("__o", F.lit(order[n])) for n, r in deltas.items()])
        last = new.groupBy(F.col(self.key).alias("__k")).agg(F.max("__o").alias("__m"))
        same = F.col(self.key).eqNullSafe(F.col("__k"))
        out = new.join(last, same & (F.col("__o") == F.col("__m"))).where(~F.col("__gone")).select(*columns)
        return base.join(last, same, "left_anti").select(*columns).unionByName(out) if base is not None else out

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of its latest commit, or of an earlier version that vacuum() has left. Ranges without deltas are
        read as they are."""
        m = self.current() if version is None else self._manifest(version)
        plain = {r: f for r, f in m["ranges"].items() if not f["deltas"]}
        rest = {r: f for r, f in m["ranges"].items() if f["deltas"]}
        parts = [self._merged(x) for x in (plain, rest) if x]
        return reduce(DataFrame.unionByName, parts) if parts else schemas.empty(self.spark, self.schema)

    # changing

    def apply(self, rows: DataFrame, gone: DataFrame | None = None, writer: str = "", batch: int | None = None, ranges: int = RANGES, most_deltas: int = MOST_DELTAS) -> dict:
        """Commits rows in place of all rows with their keys, and deletes the keys of gone that rows doesn't have.

        A batch number that a writer has committed already changes nothing, so a batch that is run again after a failure
        counts once. Conflict is raised if another commit came in between; nothing of this one is visible then. Returns
        the manifest.
        """
        base = self.current()
        if batch is not None and base["batches"].get(writer, -1) >= batch:
            return base
        rows = schemas.conform(rows, self.schema).withColumn("__gone", F.lit(False))
        if gone is not None:
            lost = gone.select(self.key).distinct().join(rows.select(self.key), self.key, "left_anti")
            rows = rows.unionByName(schemas.conform(lost, self.schema).withColumn("__gone", F.lit(True)))
        bounds = base["bounds"] if base["bounds"] is not None else self._bounds(rows, ranges)
        name, touched = self._write(rows, bounds)
        after = {r: dict(f) for r, f in base["ranges"].items()}
        for r in touched:
            held = after.setdefault(r, {"base": None, "deltas": []})
            if held["base"] or held["deltas"]:
                held["deltas"] = [*held["deltas"], [base["version"] + 1, name]]
            else:
                held["base"] = name  # the first rows of a range
        batches = {**base["batches"], **({writer: batch} if batch is not None else {})}
        done = self._commit({"bounds": bounds, "ranges": after, "batches": batches}, base)
        full = [r for r, f in done["ranges"].items() if len(f["deltas"]) > most_deltas]
        return self.compact(full) if full else done

    def upsert(self, rows: DataFrame, order: str | None = None, **more) -> dict:
        """Commits one row a key: of several the last by order (null: before all others), ties by the other columns."""
        first = [order] if order else []
        rest = [c for c in rows.columns if c not in (self.key, order)]
        if first or rest:
            rows = rows.groupBy(self.key).agg(F.max(F.struct(*first, *rest)).alias("__r")).select(self.key, "__r.*")
        return self.apply(rows, **more)

    def compact(self, ranges: Sequence[str] | None = None) -> dict:
        """Writes ranges (by default those with deltas) anew as bases; all others stay as they are."""
        base = self.current()
        chosen = {r: f for r, f in base["ranges"].items() if (f["deltas"] if ranges is None else r in ranges)}
        if not chosen:
            return base
        name, filled = self._write(self._merged(chosen).withColumn("__gone", F.lit(False)), base["bounds"])
        after = {**base["ranges"], **{r: {"base": name if r in filled else None, "deltas": []} for r in chosen}}
        return self._commit({**base, "ranges": {r: f for r, f in after.items() if f["base"] or f["deltas"]}}, base)

    def vacuum(self, kept: int = KEPT) -> list[str]:
        """Deletes manifests but the last ones, and folders that those don't name, as of commits that never came about.
        Not to be run beside a writer. Returns the folders' names."""
        versions = self._versions()
        for v in versions[:-kept]:
            fs, where = path_of(self.spark, f"{self.path}/versions/{v:012d}.json")
            fs.delete(where, False)
        named = {n for v in versions[-kept:] if (m := self._manifest(v)) for f in m["ranges"].values() for n in (f["base"], *[d for _, d in f["deltas"]]) if n}
        fs, where = path_of(self.spark, f"{self.path}/data")
        lost = [x.getPath() for x in (fs.listStatus(where) if fs.exists(where) else []) if f"data/{x.getPath().getName()}" not in named]
        for p in lost:
            fs.delete(p, True)
        return [p.getName() for p in lost]

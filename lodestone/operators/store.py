"""A store of knowledge bases: overwrite by id, deletes, lookups, scans.

A base is parquet under ``root``/name, in folders ``version=../_bucket=../type=..``: rows lie in buckets by the hash of
their id, and within a bucket by type. A manifest names the base's schema and, for each bucket, the version folder that holds it.
A write replaces the buckets it touches and no others, and becomes visible when the manifest of the next number
is there: it is written under another name and then renamed, so that no reader meets half of one and a driver that dies
leaves the base as it was. Of two writers that start from one manifest the second takes up what the first has done, if it
touched other buckets, and tries the next number; if both touched one bucket, or the schema, it fails, so no update is lost (on object
stores without an atomic rename that needs one writer at a time). Buckets of the manifest before stay until the next write,
so that frames that were read from it still run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.operators.search import predicate
from lodestone.schema import NODE_SCHEMA
from lodestone.tables import cut, release


def merged(existing: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``existing`` overwritten by ``new``; of rows that repeat a key within ``new`` the last by ``order``."""
    if order is not None:
        last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
        new = new.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def statistics(nodes: DataFrame) -> DataFrame:
    """One row on a write of nodes (type, entity_id): new_passages, new_entities (distinct), failed_passages, skipped.

    A write succeeds or fails as a whole, so no single passage fails; a write of no nodes is skipped.
    """
    return nodes.agg(
        F.count_if(F.col("type") == "passage").alias("new_passages"),
        F.count_distinct(F.when(F.col("type") == "entity", F.col("entity_id"))).alias("new_entities"),
        F.lit(0).cast("long").alias("failed_passages"),
        (F.count("*") == 0).alias("skipped"),
    )


def without_ids(rows: DataFrame, gone: DataFrame, key: str = "hash_id") -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def without_matching(rows: DataFrame, filters: dict) -> DataFrame:
    """Rows that do not match; a row on which the filter is unknown stays."""
    return rows.filter(~predicate(filters, dict(rows.dtypes)))


def by_ids(rows: DataFrame, wanted: DataFrame, key: str = "hash_id") -> DataFrame:
    """Point lookups; repeated ids count once, unknown ones find nothing."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def of_kbs(nodes: DataFrame, names: list[str], node_type: str | None = None) -> DataFrame:
    """The rows of several knowledge bases; names that do not exist find nothing."""
    rows = nodes.filter(F.col("kb").isin(names))
    return rows if node_type is None else rows.filter(F.col("type") == node_type)


class Conflict(RuntimeError):
    """Another writer has replaced what this one started from."""


#: Buckets of a new base. A bucket is the unit of a rewrite and no unit of work: Spark splits it further.
BUCKETS = 64


class NodeStore:
    """Knowledge bases under a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    @property
    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def _numbers(self, kb: str) -> list[int]:
        """The numbers of the manifests that were made visible and not yet deleted."""
        found = [s.getPath().getName() for s in (self._fs.listStatus(self._path(kb)) if self._fs.exists(self._path(kb)) else []) if s.isDirectory() or s.getLen()]
        return sorted(int(x.split("-")[1]) for x in found if x.startswith("CURRENT-"))

    def _manifest(self, kb: str, number: int) -> dict:
        """``version`` (its own name), ``buckets`` (how many), ``schema``, ``held`` (bucket: version folder), ``number``."""
        source = self._fs.open(self._path(kb, f"CURRENT-{number:09d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")) | {"number": number}
        finally:
            source.close()

    def _current(self, kb: str) -> dict | None:
        numbers = self._numbers(kb)
        return self._manifest(kb, numbers[-1]) if numbers else None

    def version(self, kb: str) -> str | None:
        """The name of the version that readers see; indexes that are stored beside a base belong to one."""
        found = self._current(kb)
        return found and found["version"]

    def exists(self, kb: str) -> bool:
        return bool(self._numbers(kb))

    def names(self) -> list[str]:
        found = self._fs.listStatus(self._path()) if self._fs.exists(self._path()) else []
        return sorted(s.getPath().getName() for s in found if self.exists(s.getPath().getName()))

    def schema(self, kb: str):
        return self.read([kb]).schema

    def create(self, kb: str) -> None:
        """Nothing happens if it exists."""
        if not self.exists(kb):
            self._replace(kb, None, NODE_SCHEMA, [], None)

    def drop(self, kb: str) -> None:
        self._fs.delete(self._path(kb), True)

    def read(self, kbs: list[str]) -> DataFrame:
        """All rows of the knowledge bases that exist; a filter on ``type`` reads the folders of that type only."""
        frames = [self._rows(kb, m).drop("_bucket") for kb in dict.fromkeys(kbs) if (m := self._current(kb))]
        if not frames:
            return self.spark.createDataFrame([], NODE_SCHEMA)
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    def _rows(self, kb: str, manifest: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of some buckets, with ``_bucket``; all of them if none are named. No footers are read for the schema."""
        schema = T.StructType.fromJson(manifest["schema"])
        held = {int(b): v for b, v in manifest["held"].items()}
        paths = [f"{self.root}/{kb}/version={held[b]}/_bucket={b}" for b in sorted(held if buckets is None else held.keys() & set(buckets))]
        full = T.StructType([*schema.fields, T.StructField("version", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        if not paths:
            return self.spark.createDataFrame([], full).drop("version")
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{kb}").parquet(*paths).select(*schema.names, "_bucket")

    def _bucket(self, manifest: dict | None):
        return F.pmod(F.xxhash64("hash_id"), F.lit(manifest["buckets"] if manifest else self.buckets)).cast("int")

    def _replace(self, kb: str, manifest: dict | None, schema: T.StructType, touched: Iterable[int], rows: DataFrame | None) -> None:
        """Write ``rows`` as the new content of the ``touched`` buckets; ``manifest`` is what they were made from."""
        version = f"v{1 + (manifest['number'] if manifest else 0)}_{uuid.uuid4().hex}"
        home = self._path(kb, f"version={version}")
        if rows is not None:  # tasks follow the size of the buckets, and each writes few folders
            typed = rows if "type" in rows.columns else rows.withColumn("type", F.lit(None).cast("string"))
            typed.withColumn("_bucket", self._bucket(manifest)).hint("rebalance", "_bucket", "type").write.partitionBy("_bucket", "type").parquet(str(home))
        try:
            filled = {s.getPath().getName() for s in self._fs.listStatus(home)} if rows is not None else set()
            news = {b: version if f"_bucket={b}" in filled else None for b in touched}
            self._commit(kb, manifest, version, schema, news)
        except Exception:
            self._fs.delete(home, True)
            raise
        self._clear(kb)

    def _commit(self, kb: str, base: dict | None, version: str, schema: T.StructType, news: dict[int, str | None]) -> None:
        """Make the manifest of the next number, over again while other writers come first and touch other buckets."""
        aside = self._path(kb, f"_pointer-{version}")
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        now, shape = base, T.StructType([T.StructField(f.name, f.dataType) for f in schema]).jsonValue()  # every column may be null
        while True:
            held = {b: v for b, v in {**(now["held"] if now else {}), **{str(b): v for b, v in news.items()}}.items() if v}
            body = {"version": version, "buckets": base["buckets"] if base else self.buckets, "schema": shape, "held": held}
            try:
                mark = self._fs.create(aside, True)
                mark.write(bytearray(json.dumps(body).encode()))
                mark.close()
                number = 1 + (now["number"] if now else 0)
                if number > max(self._numbers(kb), default=0):  # a number below may have been cleared
                    files.rename(self._fs.makeQualified(aside), self._fs.makeQualified(self._path(kb, f"CURRENT-{number:09d}")), none)
                    return
            except Exception as e:
                if "AlreadyExists" not in str(e):
                    self._fs.delete(aside, False)
                    raise
            self._fs.delete(aside, False)
            now = self._current(kb)
            if base is None or now is None or now["schema"] != base["schema"] or any(now["held"].get(str(b)) != base["held"].get(str(b)) for b in news):
                raise Conflict(f"another writer has changed the same part of {kb}; its version exists already")

    def _clear(self, kb: str) -> None:
        """Delete what neither of the last two manifests names and an older one does."""
        numbers = self._numbers(kb)
        live = {x for n in numbers[-2:] for x in self._manifest(kb, n)["held"].items()}
        for old in numbers[:-2]:
            for b, v in self._manifest(kb, old)["held"].items():
                if (b, v) not in live:
                    self._fs.delete(self._path(kb, f"version={v}", f"_bucket={b}"), True)
            self._fs.delete(self._path(kb, f"CURRENT-{old:09d}"), False)

    def upsert(self, kb: str, rows: DataFrame, order: str | None = None) -> dict:
        """Overwrite by ``hash_id``; creates the knowledge base if it is missing. Returns :func:`statistics`.

        Only the buckets that the new ids fall into are read and written again. New columns join the schema; where the type of a
        column changes, all buckets are written.
        """
        rows = cut(rows.withColumn("kb", F.lit(kb)), "upsert")  # counted and written from one run
        try:
            counts = statistics(rows).first().asDict()
            now = self._current(kb)
            if not counts["skipped"] or now is None:
                touched = [r[0] for r in rows.select(self._bucket(now)).distinct().collect()]  # as many as there are buckets
                self._upsert(kb, now, rows, touched, order)
        finally:
            release(rows)
        return counts

    def _upsert(self, kb: str, now: dict | None, rows: DataFrame, touched: list[int], order: str | None) -> None:
        held = T.StructType.fromJson(now["schema"]) if now else NODE_SCHEMA

        def full(old: DataFrame) -> DataFrame:
            out = merged(old, rows, ["kb", "hash_id"], order)
            return out.select(*held.names, *[c for c in out.columns if c not in held.names])

        new = full(self._rows(kb, now, touched).drop("_bucket") if now else self.spark.createDataFrame([], held))
        if now and any(new.schema[f.name].dataType.simpleString() != f.dataType.simpleString() for f in held):
            touched = sorted({*touched, *map(int, now["held"])})
            new = full(self._rows(kb, now).drop("_bucket"))
        self._replace(kb, now, new.schema, touched, new)

    def delete_ids(self, kb: str, ids: list[str]) -> int:
        ids = list(dict.fromkeys(ids))
        if not ids:
            raise ValueError("at least one id is needed")
        return self._delete(kb, {"hash_id": ids})

    def delete_rows(self, kb: str, ids: DataFrame) -> int:
        """Nodes whose ``hash_id`` is in a table, of any size; none to delete is no error."""
        wanted = ids.select("hash_id").distinct()
        return self._without(kb, lambda rows: by_ids(rows, wanted), lambda rows: without_ids(rows, wanted))

    def delete_files(self, kb: str, file_ids: list) -> int:
        """Every node of the files: passages, sentences and entities together."""
        return self._delete(kb, {"file_id": [str(x) for x in file_ids]})

    def delete_matching(self, kb: str, filters: dict) -> int:
        return self._delete(kb, filters)

    def _delete(self, kb: str, filters: dict) -> int:
        return self._without(kb, lambda rows: rows.filter(predicate(filters, dict(rows.dtypes))), lambda rows: without_matching(rows, filters))

    def _without(self, kb: str, gone: Callable[[DataFrame], DataFrame], stay: Callable[[DataFrame], DataFrame]) -> int:
        """Write the buckets that hold rows to go without them; returns how many went."""
        now = self._current(kb)
        if now is None:
            return 0
        each = dict(gone(self._rows(kb, now)).groupBy("_bucket").count().collect())  # as many as there are buckets
        if each:
            self._replace(kb, now, T.StructType.fromJson(now["schema"]), list(each), stay(self._rows(kb, now, each).drop("_bucket")))
        return sum(each.values())

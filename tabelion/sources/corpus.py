"""The corpus: case and document tables with last-write-wins upserts, and cursors of interrupted collections.

A table is a base and the deltas after it, each the rows of one upsert. Which files count is said by numbered manifests, of which the
highest holds: a writer writes its files, then the next manifest, which only one writer can create; whoever finds the number taken looks
at the new manifest and tries again with the number after it. So no upsert is lost, deltas have an order without clocks, and a
write that dies leaves nothing that counts.

An upsert writes its own rows and no others. Every compact_after deltas are merged into a new base, written in buckets of the key, sorted,
with Parquet's Bloom filters on it: reading joins the keys of later deltas to the base where it lies, and a search by key reads few
files. A delta that is committed while a base is being written stays a delta on top of it. What a base replaced is deleted when the next one
is written, for those who still read it. Manifests need a file system whose renames don't replace files (HDFS, a local or network disk).
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Sequence
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabelion.operators.consolidate import latest
from tabelion.session import qualified

CASE_KEY, DOCUMENT_KEY, CURSOR_KEY = ["tribunal", "numero", "grau"], ["id"], ["fonte", "recorte", "tribunal"]
KEYS = {"processos": CASE_KEY, "documentos": DOCUMENT_KEY, "progresso": CURSOR_KEY}
#: Deltas on a base, at most; rows of a bucket; rows of deltas whose keys are sent to all tasks (more are joined by a shuffle of theirs).
COMPACT_AFTER, BUCKET_ROWS, SENT_KEYS = 16, 1_000_000, 500_000
CURSOR = "fonte string, recorte string, tribunal string, cursor string, concluido boolean, atualizado_em timestamp"
_EMPTY = {"base": None, "deltas": [], "next": 0, "old": []}


class Taken(Exception):
    """The manifest's number has gone to another writer."""


class Corpus:
    def __init__(self, spark: SparkSession, root: str, compact_after: int = COMPACT_AFTER, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.root, self.compact_after, self.bucket_rows = spark, qualified(spark, root.rstrip("/")), compact_after, bucket_rows
        self._path = spark._jvm.org.apache.hadoop.fs.Path

    # -- manifests ---------------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _state(self, table: str) -> tuple[int, dict]:
        """The highest manifest and its number; -1 and an empty one if there is none."""
        log = f"{self.root}/{table}/_manifests"
        fs = self._fs(log)
        if not fs.exists(self._path(log)):
            return -1, dict(_EMPTY)
        n = max((int(name[:-5]) for s in fs.listStatus(self._path(log)) if (name := s.getPath().getName()).endswith(".json") and name[:-5].isdigit()), default=-1)
        return (n, json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{log}/{n:012d}.json", wholetext=True).collect()))) if n >= 0 else (-1, dict(_EMPTY))

    def _commit(self, table: str, n: int, manifest: dict) -> None:
        """Writes manifest number n, or raises Taken."""
        log = f"{self.root}/{table}/_manifests"
        fs, own, target = self._fs(log), self._path(f"{log}/.{uuid.uuid4().hex}.tmp"), self._path(f"{log}/{n:012d}.json")
        fs.mkdirs(self._path(log))
        out = fs.create(own)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if fs.getScheme() == "file":  # a link can't replace a file, which a local rename does
                place = lambda x: unquote(urlparse(x.toString()).path)
                os.link(place(own), place(target))
            else:
                self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(own, target, self._no_options())
        except FileExistsError as error:
            raise Taken(n) from error
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                raise Taken(n) from error
            raise
        finally:
            fs.delete(own, False)

    def _no_options(self):
        return self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _change(self, table: str, change) -> dict | None:
        """Commits change(manifest) as the next manifest, again and again until its number is free; None if change gives None."""
        while True:
            n, now = self._state(table)
            new = change(now)
            if new is None:
                return None
            try:
                self._commit(table, n + 1, new)
                return new
            except Taken:
                continue

    # -- tables ------------------------------------------------------------------------------------------------------------

    def _base(self, table: str, base: dict) -> DataFrame:
        """The base as a bucketed table, so that joins on the key leave it where it is."""
        name, keys = f"tabelion_{base['path'].rsplit('/', 1)[-1]}", ", ".join(f"`{k}`" for k in KEYS[table])
        if not self.spark.catalog.tableExists(name):
            columns = self.spark._jvm.org.apache.spark.sql.types.DataType.fromJson(json.dumps(base["schema"])).toDDL()
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {base['buckets']} BUCKETS LOCATION '{base['path']}'")
        return self.spark.table(name)

    def read(self, table: str) -> DataFrame | None:
        return self._read(table, self._state(table)[1])

    def _read(self, table: str, state: dict) -> DataFrame | None:
        keys, base = KEYS[table], state["base"] and self._base(table, state["base"])
        deltas = None
        for d in state["deltas"]:
            frame = self.spark.read.parquet(d["path"]).withColumn("__version", F.lit(d["seq"]))
            deltas = frame if deltas is None else deltas.unionByName(frame, allowMissingColumns=True)
        if deltas is None:
            return base
        fresh = latest(deltas, keys, "__version").drop("__version")
        if base is None:
            return fresh
        changed = deltas.select(*keys)
        if sum(d["rows"] for d in state["deltas"]) <= SENT_KEYS:
            changed = F.broadcast(changed)
        return base.join(changed, keys, "left_anti").unionByName(fresh, allowMissingColumns=True)

    def upsert(self, table: str, rows: DataFrame, counters: dict[str, Column] | None = None, without: Sequence[str] = ()) -> dict[str, int]:
        """Rows replace those of the same key; of rows with one key the last (by __arrived, else by all columns) counts; new columns are added.

        Gives the number of rows and the counters (aggregates), both observed while the rows are written; columns of without are counted with but not written.
        """
        keys = KEYS[table]
        if "__arrived" in rows.columns:
            fresh = latest(rows, keys, "__arrived").drop("__arrived")
        else:
            whole = F.to_json(F.struct(*rows.columns))  # an order that runs agree on
            fresh = latest(rows.withColumn("__arrived", whole), keys, "__arrived").drop("__arrived")
        seen, path = Observation(), f"{self.root}/{table}/d{uuid.uuid4().hex}"
        asked = [F.count(F.lit(1)).alias("rows"), *(c.alias(name) for name, c in (counters or {}).items())]
        fresh.observe(seen, *asked).drop(*without).write.parquet(path)
        found = {k: v or 0 for k, v in seen.get.items()}
        n = found["rows"]
        if not n and self._state(table)[0] >= 0:
            return found
        state = self._change(table, lambda now: now | {"deltas": [*now["deltas"], {"path": path, "rows": n, "seq": now["next"]}], "next": now["next"] + 1})
        if len(state["deltas"]) > self.compact_after:
            self.compact(table)
        return found

    def compact(self, table: str) -> None:
        """Merges the deltas of now into a new base. If another writer did so meanwhile, this base counts for nothing."""
        _, then = self._state(table)
        if not then["deltas"]:
            return
        merged, keys = self._read(table, then), KEYS[table]
        rows = (then["base"]["rows"] if then["base"] else 0) + sum(d["rows"] for d in then["deltas"])
        buckets, name = max(1, math.ceil(rows / self.bucket_rows)), f"b{uuid.uuid4().hex}"
        path, seen = f"{self.root}/{table}/{name}", Observation()
        writer = merged.repartition(buckets, *keys).observe(seen, F.count(F.lit(1)).alias("rows")).write.option("path", path)
        for k in keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(f"tabelion_{name}")
        base = {"path": path, "rows": seen.get["rows"], "buckets": buckets, "schema": json.loads(self.spark.table(f"tabelion_{name}").schema.json())}
        replaced = [d["path"] for d in then["deltas"]] + ([then["base"]["path"]] if then["base"] else [])
        gone = list(then["old"])

        def change(now: dict) -> dict | None:
            if now["base"] != then["base"] or now["deltas"][: len(then["deltas"])] != then["deltas"]:
                return None
            return now | {"base": base, "deltas": now["deltas"][len(then["deltas"]) :], "old": replaced}

        if self._change(table, change) is None:
            gone = [path]
        for old in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS tabelion_{old.rsplit('/', 1)[-1]}")
            self._fs(old).delete(self._path(old), True)

    def upsert_cases(self, rows: DataFrame) -> dict[str, int]:
        return self.upsert("processos", rows.withColumn("grau", F.coalesce("grau", F.lit(""))))

    def upsert_documents(self, rows: DataFrame) -> dict[str, int]:
        """Counts what was replaced in the documents, too."""
        counters = {"substituicoes": F.sum(F.aggregate(F.map_values("substituicoes"), F.lit(0), lambda a, x: a + x))} if "substituicoes" in rows.columns else None
        return self.upsert("documentos", rows, counters)

    def cases(self, with_sensitive: bool = False) -> DataFrame | None:
        return self._public(self.read("processos"), with_sensitive)

    def documents(self, with_sensitive: bool = False) -> DataFrame | None:
        return self._public(self.read("documentos"), with_sensitive)

    @staticmethod
    def _public(df: DataFrame | None, with_sensitive: bool) -> DataFrame | None:
        return df if df is None or with_sensitive else df.where(~F.col("sensivel"))

    def save_cursors(self, source: str, job: str, cursors: dict[str, tuple[object, bool]]) -> None:
        """Of each court where to go on, and whether it is done: one write for all."""
        rows = [(source, job, court, json.dumps(cursor), done) for court, (cursor, done) in cursors.items()]
        if rows:
            table = self.spark.createDataFrame(rows, "fonte string, recorte string, tribunal string, cursor string, concluido boolean")
            self.upsert("progresso", table.coalesce(1).withColumn("atualizado_em", F.current_timestamp()))

    def cursors(self, source: str, job: str) -> dict[str, tuple[object, bool]]:
        table = self.read("progresso")
        rows = table.where((F.col("fonte") == source) & (F.col("recorte") == job)).collect() if table is not None else []
        return {r["tribunal"]: (json.loads(r["cursor"]), r["concluido"]) for r in rows}  # one row a court

    def summary(self) -> dict[str, int]:
        """Rows, courts and replacements, sensitive rows included."""
        empty = self.spark.createDataFrame([], "tribunal string, substituicoes map<string,int>")
        cases, documents = (t if t is not None else empty for t in (self.read("processos"), self.read("documentos")))
        return {k: int(v) for k, v in totals(cases, documents).first().asDict().items()}


def totals(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: cases, documents, courts of either, and what was replaced in the documents."""
    replaced = F.aggregate(F.map_values("substituicoes"), F.lit(0), lambda a, x: a + x)
    p = cases.groupBy("tribunal").agg(F.count("*").alias("processos"))
    d = documents.groupBy("tribunal").agg(F.count("*").alias("documentos"), F.sum(replaced).alias("substituicoes"))
    sums = p.unionByName(d, allowMissingColumns=True)
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    return sums.agg(total("processos"), total("documentos"), F.count_distinct("tribunal").alias("tribunais"), total("substituicoes"))

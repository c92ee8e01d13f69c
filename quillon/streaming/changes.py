"""Change streams of documents: upserts and removals, applied in micro-batches.

An event is (key, content, removed, at). Within a batch the last event of a key counts; a batch may be
replayed after a failure, so tables are versioned by batch and a batch that was committed is not applied
again. Events that change nothing are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import search
from ..plans.staging import staged
from ..sources.files import from_markdown, ignore_rules, ignored, read_directory, relative, sanitised

EVENTS = "key string, content string, removed boolean, at timestamp"


def latest(events: DataFrame) -> DataFrame:
    """The last event of each key; of equal times a removal wins, then the larger content."""
    order = Window.partitionBy("key").orderBy(F.desc("at"), F.desc("removed"), F.desc("content"))
    return events.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def changes(documents: DataFrame, events: DataFrame) -> DataFrame:
    """(op, key, content): what the events change in a table of documents."""
    last = latest(events)
    both = last.join(documents.select("key", F.sha2("content", 256).alias("old")), "key", "left")
    gone = both.where("removed AND old IS NOT NULL").select(F.lit("remove").alias("op"), "key", F.lit(None).cast("string").alias("content"))
    new = both.where(~F.coalesce("removed", F.lit(False))).where(F.col("old").isNull() | (F.col("old") != F.sha2(F.coalesce("content", F.lit("")), 256)))
    return gone.unionByName(new.select(F.when(F.col("old").isNull(), "create").otherwise("update").alias("op"), "key", F.coalesce("content", F.lit("")).alias("content")))


def file_events(spark: SparkSession, path: str, extension: str = "md") -> DataFrame:
    """A stream of upserts: new and rewritten files of a folder, keyed by their paths in it.

    Hidden files, and those that the folder's ignore files name as the stream starts, are left out. Files that vanish
    raise no event here; ``vanished`` finds them.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").schema("value string").load(path)
    rows = files.select(relative(F.col("_metadata.file_path"), path).alias("rel"), "value", F.col("_metadata.file_modification_time").alias("at"))
    rows = rows.where(~ignored(F.col("rel"), ignore_rules(spark, path)))
    return rows.select(F.regexp_replace("rel", rf"\.{extension}$", "").alias("key"), sanitised(F.col("value")).alias("content"), F.lit(False).alias("removed"), "at")


def vanished(documents: DataFrame, path: str, extension: str = "md") -> DataFrame:
    """Removals: documents of a table that a folder no longer has."""
    there = read_directory(documents.sparkSession, path, extension).select("key")
    return documents.select("key").join(there, "key", "left_anti").select("key", F.lit(None).cast("string").alias("content"), F.lit(True).alias("removed"), F.current_timestamp().alias("at"))


#: Columns of a table of documents, and of a search index.
DOCUMENTS = "key string, content string"
TERMS = "key string, dl int, term string, tf int"


class DocumentTable:
    """A versioned table of documents, or of other rows with a key, in the shared store, in buckets by a hash of the key.

    A version writes only the buckets that change. Its manifest, which appears at once and last, names the
    version that holds each bucket.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, schema: str = DOCUMENTS, order: tuple[str, ...] = ("key",)):
        """``order`` sorts the rows of a file, so scans with a filter skip parts of it."""
        self.spark, self.path, self.buckets, self.schema, self.order = spark, path.rstrip("/"), buckets, schema, order
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if found := self.versions():  # a table keeps its number of buckets
            self.buckets = self._manifest(found[-1])["buckets"]

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(path))] if self._fs.exists(self._at(path)) else []

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._at(f"{self.path}/m={version}"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def versions(self) -> list[int]:
        return sorted(int(n[2:]) for n in self._names(self.path) if n.startswith("m="))

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        found = self.versions()
        holds = self._manifest(found[-1] if version is None else version)["holds"] if found else {}
        paths = [f"{self.path}/v={v}/bucket={b}" for b, v in holds.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def last_batch(self) -> int:
        """The last batch of a stream that the table has; -1 for none."""
        found = self.versions()
        return self._manifest(found[-1])["batch"] if found else -1

    def commit(self, rows: DataFrame, buckets: list[int] | None = None, batch: int | None = None) -> None:
        """A new version: these are all rows, or all rows of the given buckets. One writer at a time."""
        found = self.versions()
        version, batch = (found[-1] + 1 if found else 0), self.last_batch() if batch is None else batch
        holds = self._manifest(found[-1])["holds"] if found and buckets is not None else {}
        changed = range(self.buckets) if buckets is None else buckets
        if len(changed):
            columns = [c.split()[0] for c in self.schema.split(", ")]
            placed = rows.select(*columns, self.bucket(F.col("key")).alias("bucket"))
            placed.repartition("bucket", F.pmod(F.hash("key"), F.lit(4))).sortWithinPartitions("bucket", *self.order).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={version}")
        there = {n.removeprefix("bucket=") for n in self._names(f"{self.path}/v={version}") if n.startswith("bucket=")}
        holds = {b: v for b, v in holds.items() if int(b) not in changed} | dict.fromkeys(there, version)
        draft = self._at(f"{self.path}/_m={version}")
        stream = self._fs.create(draft, True)
        stream.write(json.dumps({"buckets": self.buckets, "batch": batch, "holds": holds}).encode())
        stream.close()
        self._fs.rename(draft, self._at(f"{self.path}/m={version}"))

    def prune(self, keep: int = 2) -> None:
        """Deletes what the latest versions don't hold."""
        found = self.versions()
        if not found:
            return
        held = {f"v={v}/bucket={b}" for m in found[-keep:] for b, v in self._manifest(m)["holds"].items()}
        for v in found[:-keep]:
            self._fs.delete(self._at(f"{self.path}/m={v}"), False)
        for v in [n for n in self._names(self.path) if n.startswith("v=") and int(n[2:]) <= found[-1]]:
            parts = [n for n in self._names(f"{self.path}/{v}") if n.startswith("bucket=")]
            gone = [n for n in parts if f"{v}/{n}" not in held]
            for n in [f"{v}/{n}" for n in gone] if len(gone) < len(parts) else [v]:
                self._fs.delete(self._at(f"{self.path}/{n}"), True)


def apply_batch(table: DocumentTable, events: DataFrame, batch: int, then: Callable[[DataFrame, int], None] | None = None) -> None:
    """Applies one micro-batch; nothing happens for a batch that is already committed. Only buckets with events are read and written."""
    if table.last_batch() < batch:
        delta = _apply(table, events, batch)
        if then:
            then(delta, batch)


def _apply(table: DocumentTable, events: DataFrame, batch: int | None) -> DataFrame:
    from ..operators.edits import apply

    events = staged(events.select("key", "content", "removed", "at"), "events")
    touched = sorted(r["b"] for r in events.select(table.bucket(F.col("key")).alias("b")).distinct().collect())  # bounded by the buckets
    documents = table.read(buckets=touched)
    delta = staged(changes(documents, events), "delta")
    table.commit(apply(documents, delta), touched, batch)
    table.prune()
    return delta


def sweep(table: DocumentTable, path: str, extension: str = "md") -> DataFrame:
    """Takes documents whose files have vanished out of the table, between two batches; gives the changes."""
    return _apply(table, vanished(table.read(), path, extension), None)


def term_index(spark: SparkSession, path: str, buckets: int = 64) -> DocumentTable:
    """A search index that is kept: pass ``read()`` to ``search.bm25`` as its index."""
    return DocumentTable(spark, path, buckets, TERMS, ("term", "key"))


def update_index(index: DocumentTable, delta: DataFrame, batch: int | None = None, analyzer: str | None = None) -> None:
    """Brings an index up to date with a change set: terms of changed and removed documents go, those of changed ones are found anew.

    No other document is read. With ``batch``, a batch that the index has is not applied again.
    """
    if batch is not None and index.last_batch() >= batch:
        return
    delta = staged(delta.select("op", "key", "content"), "delta")
    touched = sorted(r["b"] for r in delta.select(index.bucket(F.col("key")).alias("b")).distinct().collect())  # bounded by the buckets
    fresh = search.terms(from_markdown(delta.where("op <> 'remove'").select("key", "content")), analyzer)
    kept = index.read(buckets=touched).join(delta.select("key"), "key", "left_anti")
    index.commit(kept.unionByName(fresh), touched, batch)
    index.prune()


def maintain(events: DataFrame, table: DocumentTable, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Keeps a table of documents up to date with a stream of events.

    ``trigger`` is passed on: processingTime="300 milliseconds" batches bursts of edits as a debounce does.
    """
    return events.writeStream.foreachBatch(lambda df, batch: apply_batch(table, df, batch, then)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def reindexed(table: DocumentTable, keys: DataFrame):
    """The corpus of only the given documents: edges and blocks of a changed document replace its old ones."""
    return from_markdown(table.read().join(keys.select("key"), "key", "left_semi"))

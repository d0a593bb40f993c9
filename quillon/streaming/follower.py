"""A replica that follows a database's commit log with Structured Streaming.

Each commit is one file of the log. The follower streams them, copies the rows of the files that a commit added (one job a
folder, whose tasks write a folder a file) and publishes the same commit in its own folder; a batch that is replayed after a failure changes nothing, as commits already
applied are skipped. A new epoch (the master was created anew) empties the replica first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.engine import Engine
from quillon.sources.store import Files, Manifest, folder

#: The column that tells a replica's rows apart by the master's file.
FILE = "__from"


class Follower:
    def __init__(self, spark: SparkSession, master: str, replica: str, checkpoint: str):
        self.spark, self.master, self.replica, self.checkpoint = spark, master.rstrip("/"), replica.rstrip("/"), checkpoint
        self.files = Files(spark, self.replica)
        self.applied: list[int] = []

    def _known(self) -> Manifest | None:
        names = sorted(n for n in self.files.names(f"{self.replica}/_commits") if n.endswith(".json") and not n.startswith("."))
        return Manifest.of(self.files.read(f"{self.replica}/_commits/{names[-1]}")) if names else None

    @staticmethod
    def own(part: str) -> str:
        """Where the replica has the rows of a master's file."""
        return f"{folder(part)}/{FILE}={part.rpartition('/')[2]}"

    def apply(self, manifest: Manifest) -> None:
        """Copy what is new and publish."""
        known = self._known()
        if known and known.epoch != manifest.epoch:
            self.files.delete(self.replica)
            known = None
        if known and known.xid >= manifest.xid:
            return
        self.files.make(f"{self.replica}/_commits")
        there = {p for t in known.tables.values() for p in t.parts} if known else set()
        for table in manifest.tables.values():
            new: dict[str, list[str]] = {}
            for part in table.parts:
                if self.own(part) not in there:
                    new.setdefault(folder(part), []).append(f"{self.master}/{part}")
            for place, files in new.items():
                rows = self.spark.read.schema(table.schema()).parquet(*files).withColumn(FILE, F.col("_metadata.file_name"))
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FILE).parquet(f"{self.replica}/{place}")
            written = {f"{place}/{name}" for place in new for name in self.files.names(f"{self.replica}/{place}")} | there
            table.parts = [q for q in map(self.own, table.parts) if q in written]  # a file without rows leaves nothing
        self.files.publish(f"{self.replica}/_commits/{manifest.xid:020d}.json", manifest.text())
        if manifest.xid:
            self.applied.append(manifest.xid)

    def _batch(self, batch: DataFrame, _: int) -> None:
        for r in batch.selectExpr("value", "get_json_object(value, '$.epoch') AS epoch", "CAST(get_json_object(value, '$.xid') AS BIGINT) AS xid", "_metadata.file_modification_time AS made").orderBy("made", "xid").toLocalIterator():
            self.apply(Manifest.of(r["value"]))

    def start(self, seconds: float | None = 0.25) -> StreamingQuery:
        """Follow; with None apply what there is and stop."""
        log = self.spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.json").load(f"{self.master}/_commits")
        writer = log.select("value", "_metadata").writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint)
        return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{int(seconds * 1000)} milliseconds")).start()

    @property
    def engine(self) -> Engine:
        """The replica, to be read."""
        return Engine.open(self.spark, self.replica)

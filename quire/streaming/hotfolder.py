"""A watched folder as a stream: files are processed once they have arrived, and again when they change.

The source lists the folder at every trigger; a listing is written down before it is handed out, so a batch that is run again
sees the same one, and files that are in it no more are told as well.  What is known of a file stands in Spark's state store
under its path: the signature (size and time) of the last sweep and the one that was processed.  A file is ready once its
signature is the same in two sweeps and it is not empty; a signature that was processed is not processed again; a file that
vanishes is forgotten, so its return is new work.  On the first sweep files whose output is newer are done.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from quire.sources.container import opened

#: Seconds between sweeps, and the least.
EVERY, LEAST = 2.0, 0.5
LISTING = "path string, size long, time long, sweep long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def listed(folder: str, ending: str) -> dict[str, tuple[int, int]]:
    """Path -> (size, time in milliseconds) of the files below a folder; contents are not read."""
    fs, path = opened(folder)
    head = folder[: len(folder) - len(path)] if folder.endswith(path) else "file://"
    if fs.get_file_info(path).type != pafs.FileType.Directory:
        return {}
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    return {head + x.path: (x.size, (x.mtime_ns or 0) // 1_000_000) for x in found if x.type == pafs.FileType.File and x.path.endswith(ending)}


class Sweeps(D.SimpleDataSourceStreamReader):
    """A sweep of the folder a trigger; a vanished file has a null size, once."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.ending, self.log = options["path"], options.get("ending", ".pdf"), options["log"]

    def initialOffset(self) -> dict:
        return {"sweep": 0}

    def _place(self, sweep: int) -> tuple[pafs.FileSystem, str]:
        fs, path = opened(self.log)
        return fs, f"{path}/{sweep}.json"

    def _written(self, sweep: int) -> dict | None:
        fs, path = self._place(sweep)
        if fs.get_file_info(path).type != pafs.FileType.File:
            return None
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        sweep = start["sweep"] + 1
        if self._written(sweep) is None:
            own, before = listed(self.folder, self.ending), self._written(sweep - 1) or {"files": {}}
            fs, path = self._place(sweep)
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(path + ".new") as f:
                f.write(json.dumps({"files": own, "gone": [p for p in before["files"] if p not in own]}).encode())
            fs.move(path + ".new", path)
        # Spark copies the iterator, which a list's can be
        return iter(list(self._rows(sweep))), {"sweep": sweep}

    def _rows(self, sweep: int) -> Iterator[tuple]:
        known = self._written(sweep)
        for path, (size, at) in known["files"].items():
            yield path, size, at, sweep
        for path in known["gone"]:
            yield path, None, None, sweep

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for sweep in range(start["sweep"] + 1, end["sweep"] + 1):
            yield from self._rows(sweep)

    def commit(self, end: dict) -> None:
        fs, path = self._place(end["sweep"] - 2)
        if fs.get_file_info(path).type == pafs.FileType.File:
            fs.delete_file(path)


class ListingSource(D.DataSource):
    """Format `quire_listing`: path, ending, and log, the folder of the listings."""

    @classmethod
    def name(cls) -> str:
        return "quire_listing"

    def schema(self) -> str:
        return LISTING

    def simpleStreamReader(self, schema) -> D.SimpleDataSourceStreamReader:
        return Sweeps(self.options)


class Arrivals(StatefulProcessor):
    """The files (path, signature) that are ready, by what is known of each path."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "last string, done string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: r.sweep):
            if row.size is None:
                self.known.clear()
                continue
            signature = f"{row.size}:{row.time}"
            last, done = self.known.get() if self.known.exists() else (None, None)
            if row.sweep == 1 and row.written is not None and row.written >= row.time:
                done = signature
            ready = last == signature and done != signature and row.size > 0
            self.known.update((signature, signature if ready else done))
            if ready:
                yield Row(path=key[0], signature=signature)

    def close(self) -> None:
        pass


def arrivals(listing: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """path, signature of files that are ready, from a stream of listings.  outputs: path (of the source), time."""
    own = listing.withColumn("written", F.lit(None).cast("long"))
    if outputs is not None:
        own = listing.join(F.broadcast(outputs.groupBy("path").agg(F.max("time").alias("written"))), "path", "left")
    return own.groupBy("path").transformWithState(Arrivals(), "path string, signature string", "Update", "None")


def moved(ready: DataFrame, folder: str, done: str) -> DataFrame:
    """path, moved, said: moves files to another folder, with their place below the first one; each task moves its own.

    A file that cannot be moved (it vanished meanwhile) says why, and the others go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                fs, own = opened(path)
                target = f"{opened(done)[1].rstrip('/')}/{own.removeprefix(opened(folder)[1]).lstrip('/')}"
                try:
                    fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    fs.move(own, target)
                    rows.append({"path": path, "moved": True, "said": None})
                except OSError as e:
                    rows.append({"path": path, "moved": False, "said": str(e)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("moved", pa.bool_()), ("said", pa.string())]))

    return ready.select("path").mapInArrow(run, "path string, moved boolean, said string")


def watch(spark: SparkSession, folder: str, state: str, process: Callable[[DataFrame, int], None], every: float = EVERY, done: str | None = None, outputs: DataFrame | None = None, ending: str = ".pdf") -> StreamingQuery:
    """Starts the stream.  process(files, batch) gets the files that are ready (path, signature); then they are moved to `done`.

    What could not be moved is written to <state>/unmoved.  A stream started again on the same `state` goes on where it was.
    """
    spark.dataSource.register(ListingSource)
    state = state.rstrip("/")

    def batch(ready: DataFrame, number: int) -> None:
        ready = ready.persist()
        try:
            if not ready.isEmpty():
                process(ready, number)
                if done:
                    result = f"{state}/moved/{number}"
                    moved(ready, folder, done).write.mode("overwrite").parquet(result)
                    left = spark.read.parquet(result).where("not moved")
                    if not left.isEmpty():
                        left.write.mode("overwrite").parquet(f"{state}/unmoved/{number}")
        finally:
            ready.unpersist()

    listing = spark.readStream.format("quire_listing").option("ending", ending).option("log", f"{state}/listings").load(folder)
    given = spark.conf.get(PROVIDER)
    # the state of single paths needs this store; the stream keeps the setting that it was started with
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = arrivals(listing, outputs).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", f"{state}/checkpoint")
        return stream.trigger(processingTime=f"{int(1000 * max(LEAST, every))} milliseconds").start()
    finally:
        spark.conf.set(PROVIDER, given)


class Progress(StreamingQueryListener):
    """Keeps what a stream reports: (batch, seconds since the epoch, rows)."""

    def __init__(self):
        self.batches: list[tuple[int, float, int]] = []
        self.ended = False

    def onQueryStarted(self, event) -> None:
        self.ended = False

    def onQueryProgress(self, event) -> None:
        self.batches.append((event.progress.batchId, time.time(), event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended = True

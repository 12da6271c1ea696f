"""The incremental form of candidate collection: a corpus that grows, quotas for each word."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "word string, doc_id long, start int, prefix string"
#: The state store that keeps single entries of a map, which queries with `transformWithState` need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Quota(StatefulProcessor):
    """Takes places of a word until its quota is full; of what arrives together, the first by (doc_id, start).

    The state is a map keyed by place, of which a batch writes the entries that it adds, and their number.
    A word's rows of a batch pass by in frames; only as many as are still wanted are held.
    """

    def __init__(self, quota: int):
        self.quota = quota

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getMapState("taken", "doc_id long, start int", "n int")
        self.number = handle.getValueState("number", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        had = self.number.get()[0] if self.number.exists() else 0
        best: list[tuple[int, int, str | None]] = []
        seen: set[tuple[int, int]] = set()
        for frame in rows:
            if had < self.quota:
                new = [x for x in zip(frame["doc_id"].tolist(), frame["start"].tolist(), frame["prefix"].tolist(), strict=True) if x[:2] not in seen and not self.taken.containsKey(x[:2])]
                best = heapq.nsmallest(self.quota - had, {x[:2]: x for x in [*new, *best]}.values(), key=lambda x: x[:2])
                seen = {x[:2] for x in best}
        for place in best:
            self.taken.updateValue(place[:2], (1,))
        if best:
            self.number.update((had + len(best),))
            yield pd.DataFrame([(key[0], *x) for x in best], columns=["word", "doc_id", "start", "prefix"])

    def close(self) -> None:
        pass


def quota_stream(occurrences: DataFrame, quota: int) -> DataFrame:
    """The first occurrences of each word up to a quota, over all batches; a place that comes again takes none of it."""
    return occurrences.groupBy("word").transformWithStateInPandas(statefulProcessor=Quota(quota), outputStructType=OUT, outputMode="Append", timeMode="None")


def grown(spark: SparkSession, folder: str, schema: str = OUT, files_per_batch: int | None = None) -> DataFrame:
    """What has been and will be added to a folder, in order of arrival, at most so many files a batch."""
    stream = spark.readStream.schema(schema)
    return (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).parquet(folder)


def collect_available(spark: SparkSession, occurrences: DataFrame, quota: int, sink: str, checkpoint: str) -> None:
    """Process what has arrived since the last call, and stop; a lost run is taken up from the checkpoint."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    try:
        stream = quota_stream(occurrences, quota).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
        stream.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)

"""New submissions as a stream, compared with all that came before.

The index is a table of word sequences. Each micro-batch is compared with the index and with itself, then
appended to it, which is the streaming form of a run over new and old roots. A batch is written under its number,
so one that is repeated after a failure replaces what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from simloom.operators import matching, tokens


def compare_stream(documents: DataFrame, index: str, out: str, checkpoint: str, k: int = 12) -> StreamingQuery:
    """Start a query that writes ``(a, b, s1, s2, len)`` tiles of each batch of ``documents(doc_id, text)`` to ``out``."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = tokens.valid(tokens.sequences(batch), k).persist()
        new.write.mode("overwrite").parquet(f"{index}/batch={number}")
        known = spark.read.parquet(index).where(F.col("batch") <= number).select("sub", "words")
        tiles = matching.tiles(matching.maximal_runs(known, k, left=new), k)
        tiles.write.mode("overwrite").parquet(f"{out}/batch={number}")
        new.unpersist()

    return documents.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

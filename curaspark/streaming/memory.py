"""An append-only case memory fed by a stream. An extension: the batch operators do not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from curaspark.operators.retrieval import retrieved


def answered(cases: DataFrame, memory_path: str, answers_path: str, checkpoint: str, k: int = 3) -> StreamingQuery:
    """Answers each micro-batch of cases from memory and earlier cases of the batch, then appends the batch to memory.

    A replayed batch is written under its own id, so it replaces itself.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{memory_path}/batch={number}")
        memory = spark.read.parquet(memory_path).where(f"batch <= {number}").drop("batch")
        retrieved(memory, batch, k).write.mode("overwrite").parquet(f"{answers_path}/batch={number}")

    return cases.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()

"""Search of queries that arrive over time in a fixed set of subjects.

Queries join the subjects' seed table as a stream joins a static table, so no
state is kept between micro-batches; each batch goes through the same search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kinspark.operators.search import search


def stream_search(queries: DataFrame, subjects: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Hits of a stream of queries (id, seq), appended to Parquet, a folder for each batch.

    A batch that is run again after a failure overwrites its own folder.
    """

    def batch(rows: DataFrame, number: int) -> None:
        search(rows.select("id", "seq"), subjects, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

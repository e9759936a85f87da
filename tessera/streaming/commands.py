"""The command log as a stream: requests take effect once, across micro-batches and restarts.

State is one number a client and never expires, since a client's numbers have no end; no watermark applies. The
checkpoint location makes state and output survive a lost driver or executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.commands import APPLIED, DUPLICATE, GAP, STALE
from ..shipping import ship


def classify(stream: DataFrame, client: str = "client", sequence: str = "sequence", arrival: str = "arrival") -> DataFrame:
    """The stream with verdict; a micro-batch's commands of a client count in the order of arrival."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(arrival, kind="stable")
        verdicts = []
        for s in rows[sequence]:
            verdicts.append(APPLIED if s == last + 1 else DUPLICATE if s == last and s > 0 else STALE if s < last else GAP)
            last = int(s) if verdicts[-1] == APPLIED else last
        state.update((last,))
        yield rows.assign(verdict=verdicts)

    ship(stream.sparkSession)
    out = StructType([*stream.schema.fields, StructField("verdict", StringType())])
    return stream.groupBy(client).applyInPandasWithState(fold, out, "last long", "append", "NoTimeout")


def mirror(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the applied commands to a Parquet table, all that is there now; exactly once by the checkpoint."""
    return stream.where(f"verdict = '{APPLIED}'").writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)

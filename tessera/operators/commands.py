"""A replicated command log: each client numbers its requests from 1, and a request takes effect once.

classify() is the batch form, over commands in arrival order. A client's state is its last applied sequence, and
clients are independent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..shipping import ship

APPLIED, DUPLICATE, STALE, GAP = "applied", "duplicate", "stale", "gap"
KINDS = ("noop", "prewrite", "commit", "rollback", "single_shard_commit", "resolve_intent", "catalog")


def valid(commands: DataFrame, tablet_id: int, epoch: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): the checks that come before a request's number is looked at. Refused ones use no number."""
    ok = (F.col("tablet_id") == tablet_id) & (F.col("expected_epoch") == epoch) & F.col("kind").isin(*KINDS)
    ok = F.coalesce(ok, F.lit(False))
    return commands.where(ok), commands.where(~ok)


def classify(commands: DataFrame, client: str = "client", sequence: str = "sequence", arrival: str = "arrival") -> DataFrame:
    """Adds verdict. With a client's last applied number (0 at first): the next number is applied, the last one again
    is a duplicate (answered from the cached outcome), a smaller one stale, one beyond the next a gap.

    The rule is a fold in arrival order, so each client's commands meet in one task in that order; the task keeps one
    number a client and streams the rest.
    """
    schema = StructType([*commands.schema.fields, StructField("verdict", StringType())])

    def run(batches):
        import pyarrow as pa

        now, last = object(), 0
        for b in batches:
            out = []
            for c, s in zip(b.column(client).to_pylist(), b.column(sequence).to_pylist(), strict=True):
                if c != now:
                    now, last = c, 0
                out.append(GAP if s is None else APPLIED if s == last + 1 else DUPLICATE if s == last and s > 0 else STALE if s < last else GAP)
                last = s if out[-1] == APPLIED else last
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "verdict"])

    ship(commands.sparkSession)
    return commands.repartition(client).sortWithinPartitions(client, arrival).mapInArrow(run, schema)


def classify_sorted(commands: DataFrame, client: str = "client", sequence: str = "sequence") -> DataFrame:
    """The verdicts of logs whose clients send in sequence order, by lag alone: no list of a client's numbers is kept."""
    before = F.coalesce(F.lag(sequence).over(Window.partitionBy(client).orderBy(sequence)), F.lit(0))
    s = F.col(sequence)
    return commands.withColumn("verdict", F.when(s == before + 1, APPLIED).when(s == before, DUPLICATE).otherwise(GAP))


def surviving_entries(arrivals: DataFrame, replica: str = "replica", index: str = "index", term: str = "term", arrival: str = "arrival") -> DataFrame:
    """The log of each replica after replaying what arrived: at each index the last arrival, unless a later one at a
    lower index with another term than that index had truncated the log from there on."""
    w = Window.partitionBy(replica, index).orderBy(arrival)
    prior = F.lag(term).over(w)
    rows = arrivals.withColumn("_cuts", prior.isNotNull() & (prior != F.col(term)))
    later_cut = Window.partitionBy(replica).orderBy(F.desc(arrival)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_lowest_cut", F.min(F.when(F.col("_cuts"), F.col(index))).over(later_cut))
    rows = rows.where(F.col("_lowest_cut").isNull() | (F.col(index) < F.col("_lowest_cut")))
    last = Window.partitionBy(replica, index).orderBy(F.desc(arrival))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_cuts", "_lowest_cut")

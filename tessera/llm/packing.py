"""Best-fit packing by minimum bin slack.

Which sequence a piece goes to depends on its length alone, so the plan is made from the histogram of lengths, which
has at most `capacity` rows for a corpus of any size. For each bin the longest length left is set and a bitset
subset-sum over the lengths left (a bit for each fill, a shift for each item) finds the fullest combination with it;
the combination is applied as often as its lengths last and removed. The plan is a table of intervals: pieces number
a to b of a length go to these sequences at this offset.

Pieces are numbered within their length without gathering a length in one task: a task numbers its own pieces, and
the counts of (task, length) give where its numbers begin.

Defined cases: null and empty texts are the end id alone; rows with null ids and repeated rows are packed like others;
only documents longer than the capacity are cut, the first piece takes the remainder; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import cut, map_batches
from ._tokens import encoder


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % capacity if n > capacity else n
    edges = [0, *range(first or capacity, n + 1, capacity)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, number (in its task and length) and, if wanted, ids (binary)."""

    def make():
        from pyspark import TaskContext

        tool, task = encoder(tokenizer), TaskContext.get().partitionId()
        end, given = np.array([end_id], "<u4").tobytes(), defaultdict(int)

        def of(batch: pa.RecordBatch) -> dict:
            out = defaultdict(list)
            for key, ids in zip(batch.column("i").to_pylist(), tool.encode(batch.column("t")), strict=True):
                ids += end
                for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    for name, x in (("doc_id", key), ("piece", k), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(own)), ("task", task), ("number", given[length])):
                        out[name].append(x)
                    if with_ids:
                        out["ids"].append(own)
                    given[length] += 1
            return out if out else None

        return of

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(docs[doc_id].alias("i"), docs[text].alias("t")), make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, number long" + ", ids binary" * with_ids, tokenizes=True)


def fullest(left: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a subset of the lengths left (length -> how many) whose sum is the largest up to room."""
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in left if x <= room), reverse=True):
        many, k = min(left[length], room // length), 1
        while many > 0:
            k = min(k, many)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & full
            many, k = many - k, 2 * k
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] += k
            at -= length * k
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Intervals (length, first number, pieces a sequence, first sequence, offset) and the number of sequences."""
    left = {k: v for k, v in histogram.items() if v > 0}
    done, out, sequence = defaultdict(int), [], 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        chosen = dict(fullest({k: v for k, v in rest.items() if v}, capacity - longest))
        chosen[longest] = chosen.get(longest, 0) + 1
        times, offset = min(left[k] // n for k, n in chosen.items()), 0
        for length, n in sorted(chosen.items(), reverse=True):
            out.append((length, done[length], n, sequence, offset))
            done[length] += n * times
            left[length] -= n * times
            offset += n * length
            if not left[length]:
                del left[length]
        sequence += times
    return out, sequence


def place(numbered: DataFrame, capacity: int) -> DataFrame:
    """numbered: any columns with length, task and number. Adds sequence_id and offset, drops task and number."""
    counts = cut(numbered.groupBy("task", "length").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    intervals, _ = plan(histogram, capacity)
    tool = numbered.sparkSession.sparkContext.broadcast(sorted(intervals))
    placed = numbered.join(first, ["task", "length"]).withColumn("number", F.col("number") + F.col("_first")).drop("_first", "task")
    kept = [f for f in placed.columns if f != "number"]

    def make():
        t = np.array(tool.value, np.int64).reshape(-1, 5)
        keys = (t[:, 0] << 44) | t[:, 1]

        def of(batch: pa.RecordBatch) -> dict:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            row = t[np.searchsorted(keys, (length << 44) | number, side="right") - 1]
            turn = number - row[:, 1]
            return {c: batch.column(c) for c in kept} | {"sequence_id": row[:, 3] + turn // row[:, 2], "offset": row[:, 4] + turn % row[:, 2] * length}

        return of

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name != "number")
    return map_batches(placed, make, ddl + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece, with its ids if wanted."""
    return place(cut(pieces(docs, tokenizer, capacity, end_id, with_ids, text, doc_id)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids (binary, little-endian 32-bit) from pack(..., with_ids=True)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x.ids)).alias("ids"))

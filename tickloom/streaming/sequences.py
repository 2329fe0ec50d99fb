"""Sequence numbers of endless feeds: exact deduplication and gaps, without a horizon.

Numbers are kept as intervals per (connection, range of ``WIDTH`` numbers) in Spark's state store. A feed without loss needs one interval
per range whatever its length, a gap adds one, and a frame that fills it late joins two. Ranges spread a busy connection over
the tasks. Nothing is forgotten, so a copy is known however late it comes; a state of numbers in disorder is at most half a range.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators import prefix

WIDTH = 1 << 16
_STATE = "starts array<int>, ends array<int>"


class Intervals:
    """Whole numbers as closed intervals in order."""

    def __init__(self, starts=(), ends=()):
        self.starts, self.ends = [int(s) for s in starts], [int(e) for e in ends]

    def add(self, number: int) -> bool:
        """Add a number; False if it was there."""
        at = bisect_right(self.starts, number) - 1
        if at >= 0 and number <= self.ends[at]:
            return False
        joins_left = at >= 0 and self.ends[at] == number - 1
        joins_right = at + 1 < len(self.starts) and self.starts[at + 1] == number + 1
        if joins_left and joins_right:
            self.ends[at] = self.ends[at + 1]
            del self.starts[at + 1], self.ends[at + 1]
        elif joins_left:
            self.ends[at] = number
        elif joins_right:
            self.starts[at + 1] = number
        else:
            self.starts.insert(at + 1, number)
            self.ends.insert(at + 1, number)
        return True


def _slot(seq: str):
    """Number of the range; rows without a number are in a range of their own."""
    return F.floor(F.col(seq).cast("decimal(20,0)") / WIDTH).cast("bigint")


def _inside(seq: str):
    """Place of a number in its range."""
    return (F.col(seq).cast("decimal(20,0)") % WIDTH).cast("int")


def deduplicated_exactly(stream: DataFrame, seq: str = "msg_seq_num", order: str = "recv_order") -> DataFrame:
    """The first copy of every message of ``stream``, however late others come; first is the least ``order`` of a micro-batch.

    Rows without a sequence number have no copies and are all kept. Other columns pass through.
    """
    names = stream.columns

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = Intervals(*state.get) if state.exists else Intervals()
        # All rows of a range in a micro-batch; those of one task's share of it, as the state itself is.
        rows = pd.concat(list(batches)).sort_values("_order", kind="stable")
        kept = [pd.isna(n) or seen.add(int(n)) for n in rows["_seq"]]
        state.update((seen.starts, seen.ends))
        yield rows.loc[kept, names]

    dealt = stream.withColumns({"_slot": _slot(seq), "_seq": _inside(seq), "_order": F.col(order)})
    return dealt.groupBy("connection_id", "_slot").applyInPandasWithState(keep, stream.schema, _STATE, "append", GroupStateTimeout.NoTimeout)


def tracked(stream: DataFrame, seq: str = "msg_seq_num") -> DataFrame:
    """Keeps what numbers came, and gives ``connection_id, new, copies`` per range and micro-batch.

    The numbers themselves are in the query's state; :func:`gaps_of` reads the gaps from it.
    """

    def note(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, new, all_ = Intervals(*state.get) if state.exists else Intervals(), 0, 0
        for rows in batches:
            numbers = rows["_seq"].dropna()
            all_ += len(numbers)
            new += sum(seen.add(int(n)) for n in numbers)
        state.update((seen.starts, seen.ends))
        yield pd.DataFrame({"connection_id": [key[0]], "new": [new], "copies": [all_ - new]})

    kind = stream.schema["connection_id"].dataType
    out = T.StructType([T.StructField("connection_id", kind), T.StructField("new", T.LongType()), T.StructField("copies", T.LongType())])
    dealt = stream.select("connection_id", _slot(seq).alias("_slot"), _inside(seq).alias("_seq"))
    return dealt.groupBy("connection_id", "_slot").applyInPandasWithState(note, out, _STATE, "append", GroupStateTimeout.NoTimeout)


def received(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``connection_id, first, last``: runs of numbers received so far, by range, out of the state of a query of this module."""
    state = spark.read.format("statestore").load(checkpoint)
    kept = state.select("key.connection_id", "key._slot", "value.groupState.*").filter("_slot is not null")
    runs = kept.select("connection_id", "_slot", F.explode(F.arrays_zip("starts", "ends")).alias("run"))
    number = lambda place: (F.col("_slot").cast("decimal(20,0)") * WIDTH + F.col(place)).cast("decimal(20,0)")
    return runs.select("connection_id", number("run.starts").alias("first"), number("run.ends").alias("last"))


def gaps_of(runs: DataFrame) -> DataFrame:
    """``connection_id, after_seq, before_seq, missing`` between the runs of each connection.

    There is a run per gap and range, far fewer than frames; they are ordered in chunks of the number axis.
    """
    shift = F.lit(str(1 << 63)).cast("decimal(20,0)")
    shifted = lambda c: (F.col(c) - shift).cast("bigint")
    placed = runs.select("connection_id", shifted("first").alias("first"), shifted("last").alias("last"))
    pairs = prefix.following(placed, ["connection_id"], "first", {"next": "first"})
    back = lambda c: (F.col(c).cast("decimal(20,0)") + shift).cast("decimal(20,0)")
    pairs = pairs.filter(F.col("next") - 1 > F.col("last"))
    return pairs.select(
        "connection_id", back("last").alias("after_seq"), back("next").alias("before_seq"),
        (back("next") - back("last") - 1).cast("decimal(20,0)").alias("missing"),
    )

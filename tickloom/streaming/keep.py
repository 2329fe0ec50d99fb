"""Keep-series output of a stream: every known tag set reappears at every flush, with empty fields where it was idle.

Input is a stream of closed metrics, as :mod:`tickloom.streaming.roll` writes them: rows of a bucket come once, buckets never go back.
The known tag sets are a registry in Spark's state store, dealt over ``SHARDS`` groups by a hash, so that many sets are spread over the
tasks. A flush has to reach sets that have no row in it, so each new bucket sends one mark to every shard. A shard gives a bucket out
when the mark of a later one arrives, as its rows may come in several micro-batches; :data:`END` marks the end of a feed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SHARDS = 64
END = (1 << 63) - 1  # a bucket after all others

_STATE = (
    "sets array<string>, starts array<bigint>, marks array<bigint>, buckets array<bigint>, tags array<string>, fields array<string>"
)
_OUT = "tags string, series_start bigint, bucket_ts bigint, fields string"


def kept_series(metrics: DataFrame, tags: Sequence[str], shards: int = SHARDS) -> DataFrame:
    """``tags, series_start, bucket_ts`` and the fields of every known tag set for every bucket of the stream.

    A row without any tag value and with bucket :data:`END` ends the feed; without it the last bucket is still waiting.
    """
    fields = [c for c in metrics.columns if c not in (*tags, "bucket_ts")]
    types = {f.name: f.dataType for f in metrics.schema}
    packed = lambda names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    rows = metrics.filter(F.col("bucket_ts") < END).select(
        F.pmod(F.xxhash64(*tags), F.lit(shards)).cast("int").alias("shard"), "bucket_ts", packed(tags).alias("tags"), packed(fields).alias("fields")
    )
    marks = metrics.select("bucket_ts").dropDuplicates(["bucket_ts"]).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "bucket_ts",
        F.lit(None).cast("string").alias("tags"), F.lit(None).cast("string").alias("fields"),
    )
    dealt = rows.unionByName(marks).groupBy("shard")
    out = dealt.applyInPandasWithState(_flushed, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
    read = lambda column, names: F.from_json(column, ", ".join(f"`{n}` {types[n].simpleString()}" for n in names))
    parts = out.select(read("tags", tags).alias("t"), "series_start", "bucket_ts", read("fields", fields).alias("f"))
    return parts.select("t.*", "series_start", "bucket_ts", *[F.col(f"f.`{c}`").alias(c) for c in fields])


def _flushed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    sets, starts, marks, buckets, tags, fields = (list(v) for v in state.get) if state.exists else ([] for _ in range(6))
    for rows in batches:
        marked = rows["tags"].isna()
        marks += rows.loc[marked, "bucket_ts"].tolist()
        data = rows[~marked]
        buckets += data["bucket_ts"].tolist()
        tags += data["tags"].tolist()
        fields += data["fields"].tolist()
    known, out = dict(zip(sets, starts)), []
    waiting: dict[int, dict[str, str]] = {}
    for bucket, one, values in zip(buckets, tags, fields):
        waiting.setdefault(int(bucket), {})[one] = values
    marks = sorted({int(m) for m in marks})
    while len(marks) > 1:  # a later bucket has begun, so the first is complete
        bucket = marks.pop(0)
        values = waiting.pop(bucket, {})
        for one in values:
            known.setdefault(one, bucket)
        out += [(one, start, bucket, values.get(one)) for one, start in known.items()]
    rest = [(bucket, one, values) for bucket, rows in waiting.items() for one, values in rows.items()]
    state.update((list(known), list(known.values()), marks, *([r[i] for r in rest] for i in range(3))))
    yield pd.DataFrame(out, columns=["tags", "series_start", "bucket_ts", "fields"])

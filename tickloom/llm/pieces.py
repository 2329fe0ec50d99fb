"""Piece encoding and decoding of whole texts with a public merge-type vocabulary.

Encoding is by backtracking: the longest piece at each place (by dictionary), two neighbours checked by merging them anew, and
a bitfield of places from which no encoding goes on (:mod:`tickloom.llm.piecemodel`). It gives what merging the whole text
gives. Work is per row; nothing is shuffled, and a worker's memory of units it has seen is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.held import give_back, held
from tickloom.llm.piecemodel import Decoder, Encoder, read_model


# Letters of texts, or bytes of ids, whose results a worker gathers before it gives them out.
PART = 1 << 20


def coders_of(model: bytes) -> tuple[Encoder, Decoder]:
    def make() -> tuple[Encoder, Decoder]:
        read = read_model(model)
        return Encoder(read), Decoder(read)

    return held(("pieces", hash(model)), make)


def in_parts(batches: Iterator[pa.Array], one: Callable[[Any], Any], made: Callable[[list], pa.Array]) -> Iterator[pa.Array]:
    """``made`` of the results of ``one``, row by row, some at a time whatever the number of rows in a batch."""
    for batch in batches:
        results, size = [], 0
        for i, row in enumerate(batch):
            row = row.as_py()
            results.append(one(row))
            size += len(row or "")
            if size >= PART or i + 1 == len(batch):
                yield made(results)
                results, size = [], 0
        if not len(batch):
            yield made([])
    give_back()


class Pieces:
    """Columns of ids and texts for one vocabulary file, which is read on the driver and sent to the workers once."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as file:
            content = file.read()
        read_model(content)  # an unsupported model fails here, before any task
        model = spark.sparkContext.broadcast(content)

        def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from in_parts(texts, coders_of(model.value)[0].encode, lambda rows: pa.array(rows, pa.binary()))

        def decode(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
            one = coders_of(model.value)[1].decode
            yield from in_parts(ids, lambda row: None if row is None else one(row), lambda rows: pa.array(rows, pa.string()))

        def there_and_back(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder, decoder = coders_of(model.value)

            def both(text: str | None) -> tuple[bytes, str]:
                ids = encoder.encode(text)
                return ids, decoder.decode(ids)

            def made(rows: list[tuple[bytes, str]]) -> pa.Array:
                columns = [pa.array([ids for ids, _ in rows], pa.binary()), pa.array([text for _, text in rows], pa.string())]
                return pa.StructArray.from_arrays(columns, ["ids", "decoded"])

            yield from in_parts(texts, both, made)

        self._encode = F.arrow_udf("binary")(encode)
        self._decode = F.arrow_udf("string")(decode)
        self._both = F.arrow_udf("ids binary, decoded string")(there_and_back)

    def ids(self, text: Column) -> Column:
        """Ids with begin and end, as little-endian unsigned 32-bit integers; a null text is taken as empty."""
        return self._encode(text)

    def text(self, ids: Column) -> Column:
        """The text of such ids; null for null."""
        return self._decode(ids)


    def both(self, text: Column) -> Column:
        """STRUCT of the ids and of the text decoded from them, by one worker."""
        return self._both(text)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids BINARY, decoded STRING`` of every row of ``docs``, repeated rows included.

    Null and empty texts give the begin and end ids alone and an empty decoded text; a null key is kept. Very long texts are
    encoded in one piece; an empty table gives an empty one. Other columns of ``docs`` are not read, whatever their names.
    """
    pieces = Pieces(docs.sparkSession, path)
    rows = docs.select(F.col(key).alias(key), pieces.both(F.col(text).cast("string")).alias("_both"))
    return rows.select(key, "_both.ids", "_both.decoded")

"""Rows that a later join can match, told before its shuffle by hashed bits of the other side's ids.

The set of bits has a bounded size. What passes wrongly finds no partner in the join, so results never depend on it: beyond its
bound more rows pass, at worst all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import mix

#: Bits for each id, the least and most bits, bytes that are sent together.
BITS, LEAST_BITS, MOST_BITS, PAGE = 16, 1 << 16, 1 << 27, 1 << 16


def probes(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each id."""
    mark = mix(ids.view(np.uint64))
    return tuple((x & np.uint64(bits - 1)).astype(np.int64) for x in (mark, mark >> np.uint64(32)))


def passes(ids: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether each id (64-bit integers) may be one of those whose bits are set."""
    first, second = (bitmap[at >> 3] >> (at & 7).astype(np.uint8) for at in probes(ids, 8 * len(bitmap)))
    return (first & second & np.uint8(1)).astype(bool)


def bits_of(ids: DataFrame, rows: int) -> Broadcast:
    """The bits of a table of one column of ids, about `rows` of them. Tasks send pages of bits, equal pages meet; the driver gets the bits alone."""
    bits = min(max(1 << (BITS * rows).bit_length(), LEAST_BITS), MOST_BITS)
    page = min(PAGE, bits // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            for at in probes(batch.column(0).to_numpy(), bits):
                np.bitwise_or.at(found, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        pages = found.reshape(-1, page)
        some = np.flatnonzero(pages.any(axis=1))
        yield pa.RecordBatch.from_pydict({"page": pa.array(some, pa.int64()), "bits": pa.array([pages[i].tobytes() for i in some], pa.binary())})

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        out = np.zeros(page, dtype=np.uint8)
        for b in table.column("bits"):
            out |= np.frombuffer(b.as_buffer(), dtype=np.uint8)
        return pa.table({"page": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    whole = np.zeros((bits // 8 // page, page), dtype=np.uint8)
    for row in ids.mapInArrow(run, "page long, bits binary").groupBy("page").applyInArrow(meet, "page long, bits binary").collect():  # at most MOST_BITS / 8 bytes in all
        whole[row["page"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return ids.sparkSession.sparkContext.broadcast(whole.tobytes())


def sieved(df: DataFrame, key: str, ids: DataFrame, rows: int) -> DataFrame:
    """The rows of `df` whose key may be among the ids: all that are, and few others."""
    sent, at = bits_of(ids, rows), df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sent.value, dtype=np.uint8)
        for batch in batches:
            yield batch.take(pa.array(np.flatnonzero(passes(batch.column(at).to_numpy(), bitmap))))

    return df.mapInArrow(run, df.schema)


def ends(pairs: DataFrame) -> DataFrame:
    """Both ids of every pair (a, b), as one column."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))

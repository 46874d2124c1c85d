"""Token ids in training order as fixed-stride binary shards (operator 6).

Sequences are numbered densely: a first pass counts the sequences of every input partition, a second one numbers them
from its partition's offset. A keyed Feistel network over the smallest even number of bits that holds all numbers,
walked along its cycle until the result is below the number of sequences, permutes them: every sequence gets a
global slot, and every slot a sequence, without a global sort or a table of the order. A shard is a range of ``shard_rows``
slots and one file of records of equal length in slot order, so slot ``s`` starts at byte
``(s % shard_rows) * stride`` of shard ``s // shard_rows``: readers go on from any slot and read ahead.

A record is: document id (signed 64 bit), part within the document (unsigned 32 bit), number of ids (unsigned 32
bit), ``length`` ids of ``width`` bytes padded with zeros, and a closing newline byte; numbers are little-endian.
Spark's own text writer writes the files, whose commit protocol survives lost executors. Every sequence is
moved once, deflated.

Input has to be a stored table (a scan of files), so that a task that runs again sees the same rows. Texts that are
null or empty have one sequence without ids. Rows without an id are written with id -1.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm.common import ship_package

HEADER = "<qII"
HEADER_BYTES = struct.calcsize(HEADER)
END = b"\n"
ROUNDS = 6


@dataclass(frozen=True)
class Layout:
    """Ids of a sequence, bytes of an id, and sequences of a shard."""

    length: int = 1024
    width: int = 1
    shard_rows: int = 8192

    @property
    def stride(self) -> int:
        return HEADER_BYTES + self.length * self.width + len(END)

    def place(self, slot: int) -> tuple[int, int]:
        """Shard and byte offset of a slot."""
        return slot // self.shard_rows, slot % self.shard_rows * self.stride


def mixed(values: np.ndarray, key: int) -> np.ndarray:
    """Keyed 64-bit mixing of a round (xor-shift multiply)."""
    values = (values ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def slots_of(numbers: np.ndarray, count: int, key: str) -> np.ndarray:
    """Slots of the sequence numbers: a permutation of ``range(count)`` chosen by ``key``."""
    half = max(1, ((max(count, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [xxhash.xxh64_intdigest(f"{key}/{i}") for i in range(ROUNDS)]

    def network(values: np.ndarray) -> np.ndarray:
        left, right = values >> shift, values & mask
        for round_key in keys:
            left, right = right, left ^ (mixed(right, round_key) & mask)
        return left << shift | right

    slots = network(numbers.astype(np.uint64))
    while (outside := slots >= np.uint64(count)).any():
        slots[outside] = network(slots[outside])
    return slots.astype(np.int64)


def byte_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids``: the UTF-8 bytes of each whole text as ids of one byte."""
    return docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("ids"))


def count_by_partition(tokens: DataFrame, layout: Layout) -> list[int]:
    """Sequences of each input partition; one number per partition comes back."""
    size = F.coalesce(F.octet_length("ids"), F.lit(0))
    parts = F.greatest(F.ceil(size / (layout.length * layout.width)), F.lit(1))
    rows = tokens.select(F.spark_partition_id().alias("partition"), parts.alias("parts"))
    counts = {row[0]: row[1] for row in rows.groupBy("partition").agg(F.sum("parts")).collect()}
    return [counts.get(i, 0) for i in range(max(counts, default=-1) + 1)]


def sequences(tokens: DataFrame, layout: Layout, key: str, counts: list[int]) -> DataFrame:
    """``shard, slot, head, packed`` per sequence: the record's header, and its ids deflated for the way."""
    total, starts = sum(counts), np.cumsum([0, *counts]).tolist()
    ship_package(tokens.sparkSession)
    step = layout.length * layout.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = starts[TaskContext.get().partitionId()]
        for batch in batches:
            heads, packed = [], []
            for doc_id, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = ids or b""
                for part, at in enumerate(range(0, max(len(ids), 1), step)):
                    piece = ids[at : at + step]
                    heads.append(struct.pack(HEADER, -1 if doc_id is None else doc_id, part, len(piece) // layout.width))
                    packed.append(zlib.compress(piece, 1, -zlib.MAX_WBITS))
            slots = slots_of(np.arange(number, number + len(heads)), total, key)
            number += len(heads)
            columns = [pa.array((slots // layout.shard_rows).astype(np.int32)), pa.array(slots)]
            columns += [pa.array(heads, pa.binary()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "slot", "head", "packed"])

    return tokens.select("id", "ids").mapInArrow(run, "shard int, slot long, head binary, packed binary")


def records(rows: DataFrame, layout: Layout) -> DataFrame:
    """``shard, slot, record`` of moved sequences; the record is padded and without its closing byte."""
    step = layout.length * layout.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("head").to_pylist(), batch.column("packed").to_pylist(), strict=True)
            made = [head + zlib.decompress(packed, -zlib.MAX_WBITS).ljust(step, b"\0") for head, packed in pairs]
            columns = [batch.column("shard"), batch.column("slot"), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "slot", "record"])

    return rows.mapInArrow(run, "shard int, slot long, record binary")


def write_shards(tokens: DataFrame, path: str, key: str, layout: Layout = Layout()) -> int:
    """Write all sequences of ``tokens`` (``id, ids``) below ``path`` as ``shard=N`` folders of one file; their number."""
    counts = count_by_partition(tokens, layout)
    total = sum(counts)
    n_shards = max(1, -(-total // layout.shard_rows))
    moved = sequences(tokens, layout, key, counts).repartitionById(n_shards, F.col("shard"))
    rows = records(moved, layout).sortWithinPartitions("shard", "slot").select("shard", F.col("record").cast("string"))
    rows.write.partitionBy("shard").option("lineSep", END.decode()).text(path)
    return total


def read_shards(spark: SparkSession, path: str, layout: Layout = Layout(), first_slot: int = 0) -> DataFrame:
    """``slot, shard, byte_offset, doc_id, part, n_tokens, ids`` of the sequences from ``first_slot`` on.

    Shards in front of it are not opened. ``ids`` is without padding. A shard of a wrong length is an error.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    files = files.where(F.col("shard") >= first_slot // layout.shard_rows).select("shard", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if len(content) % layout.stride:
                    raise ValueError(f"shard {shard} has {len(content)} bytes, no multiple of {layout.stride}")
                rows = []
                for at in range(0, len(content), layout.stride):
                    doc_id, part, n_tokens = struct.unpack_from(HEADER, content, at)
                    start = at + HEADER_BYTES
                    ids = content[start : start + n_tokens * layout.width]
                    rows.append((shard * layout.shard_rows + at // layout.stride, shard, at, doc_id, part, n_tokens, ids))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=READ_NAMES)

    made = files.mapInArrow(run, READ_SCHEMA)
    return made.where(F.col("slot") >= first_slot)


READ_NAMES = ["slot", "shard", "byte_offset", "doc_id", "part", "n_tokens", "ids"]
READ_SCHEMA = "slot long, shard int, byte_offset long, doc_id long, part long, n_tokens long, ids binary"

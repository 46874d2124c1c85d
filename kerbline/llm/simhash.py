"""Near-duplicates by SimHash with a byte-position inverted index and count filtering (operator 2).

A fingerprint has eight bytes. Two fingerprints with at most three differing bits differ in at most three bytes,
so at least five positional bytes are shared: that is the guaranteed minimum of matches. Posting lists are
kept for four positions at a time, for the fourteen position sets whose numbers cancel under exclusive or;
every five positions hold exactly one of them, so each pair that can reach the minimum meets in a posting
list, and lists are 2^24 times shorter than those of single bytes. A pair that meets is tallied (shared positional
bytes), kept when it reaches the minimum, and verified by its differing bits.

Equal fingerprints are one entry of the index. Posting lists up to ``LIST_ENTRIES`` are joined directly.
Longer ones are split into blocks of about that size and compared block by block inside tasks, which give back
no more links per block pair than connect it; nothing is capped and no link between components is lost.

``drop_near_duplicates`` keeps one of the texts that are so linked. Its ``settings`` widen the groups: pairs at a
Jaccard similarity of 0.8 differ in about ten of 64 bits, more than any index of positional bytes reaches without lists as
long as the corpus, so texts that are similar by their full sets of shingles are linked besides, through ``minhash.py``.
Every link of the index stays a link, and a group is what either kind connects.

Texts are read whole; null and texts without words have fingerprint zero. Components are named by their
smallest id; rows whose id is null take part with their text but name no component.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import xor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm import minhash
from kerbline.llm.common import join_groups, map_arrow, ship_package, stored, with_row, without_rows
from kerbline.llm.components import components

SEED = 42
MAX_BITS = 3
MIN_BYTES = 8 - MAX_BITS
SHINGLE_WORDS = 3
LIST_ENTRIES = 256
#: Position sets of the index: four of the eight byte positions.
POSITIONS = [four for four in combinations(range(8), 4) if reduce(xor, four) == 0]

TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode().translate(TO_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    span = min(SHINGLE_WORDS, len(words)) - 1
    starts, ends = starts[: len(words) - span], ends[span:]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), COUNTED):
        pairs = zip(starts[at : at + COUNTED].tolist(), ends[at : at + COUNTED].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fp`` (the fingerprint's bits as a signed long) per row."""

    def work():
        def compute(texts: pa.Array) -> list[pa.Array]:
            prints = np.array([fingerprint(text) for text in texts.to_pylist()], np.uint64)
            return [pa.array(prints.view(np.int64))]

        return compute

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, ["text"], ["id"], [T.StructField("fp", T.LongType())], work)


def byte_at(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def shared_bytes(difference: Column) -> Column:
    return sum((byte_at(difference, i) == 0).cast("int") for i in range(8))


def postings(classes: DataFrame) -> DataFrame:
    """Fourteen rows ``list, fp, rep`` per fingerprint; ``list`` holds the position set and the four bytes."""
    lists = []
    for number, positions in enumerate(POSITIONS):
        parts = [F.shiftleft(byte_at(F.col("fp"), p), 8 * i) for i, p in enumerate(positions)]
        lists.append(reduce(lambda a, b: a.bitwiseOR(b), parts, F.lit(number << 32).cast("long")))
    return classes.select(F.explode(F.array(*lists)).alias("list"), "fp", "rep")


def linking(a: Column, b: Column) -> Column:
    """The tally of shared positional bytes reaches its minimum, and the bits agree."""
    difference = a.bitwiseXOR(b)
    return (shared_bytes(difference) >= MIN_BYTES) & (F.bit_count(difference) <= MAX_BITS)


def block_links(batches):
    """Links that connect what two blocks of a posting list hold; each row brings both blocks."""
    popcount = np.array([bin(i).count("1") for i in range(256)], np.uint8)
    for batch in batches:
        out_a, out_b = [], []
        columns = [batch.column(name).to_pylist() for name in ("fps_a", "reps_a", "fps_b", "reps_b")]
        for fps_a, reps_a, fps_b, reps_b in zip(*columns, strict=True):
            left, right = np.array(fps_a, np.int64), np.array(fps_b, np.int64)
            root: dict[int, int] = {}

            def find(node: int, root=root) -> int:
                while root.setdefault(node, node) != node:
                    root[node] = node = root[root[node]]
                return node

            for i, fp in enumerate(left):
                apart = (right ^ fp).view(np.uint8).reshape(-1, 8)
                near = ((apart == 0).sum(1) >= MIN_BYTES) & (popcount[apart].sum(1) <= MAX_BITS)
                for j in np.flatnonzero(near).tolist():
                    a, b = find(reps_a[i]), find(reps_b[j])
                    if a != b:
                        root[a] = b
                        out_a.append(reps_a[i])
                        out_b.append(reps_b[j])
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def links(classes: DataFrame, list_entries: int = LIST_ENTRIES) -> DataFrame:
    """Links ``a, b`` between classes (``fp, rep``) at up to three bits, enough to connect all that are linked."""
    entries = stored(postings(classes), "postings")
    sizes = entries.groupBy("list").agg(F.count("*").alias("entries")).where("entries > 1")
    sizes = stored(sizes, "posting-sizes")
    short = entries.join(sizes.where(F.col("entries") <= list_entries), "list")
    direct = (
        short.select("list", F.col("fp").alias("fp_a"), F.col("rep").alias("a"))
        .join(short.select("list", F.col("fp").alias("fp_b"), F.col("rep").alias("b")), "list")
        .where((F.col("fp_a") < F.col("fp_b")) & linking(F.col("fp_a"), F.col("fp_b")))
        .select("a", "b")
    )
    long = sizes.where(F.col("entries") > list_entries)
    if long.isEmpty():
        return direct
    n_blocks = F.ceil(F.col("entries") / list_entries).cast("int")
    blocked = entries.join(long, "list").withColumn("block", F.pmod(F.xxhash64("fp"), n_blocks).cast("int"))
    blocks = blocked.groupBy("list", "block").agg(
        F.collect_list("fp").alias("fps"), F.collect_list("rep").alias("reps")
    )
    blocks = stored(blocks, "posting-blocks")
    left = blocks.select("list", *(F.col(c).alias(f"{c}_a") for c in ("block", "fps", "reps")))
    right = blocks.select("list", *(F.col(c).alias(f"{c}_b") for c in ("block", "fps", "reps")))
    pairs = left.join(right, "list").where("block_a <= block_b").select("fps_a", "reps_a", "fps_b", "reps_b")
    ship_package(pairs.sparkSession)
    # A row carries two blocks of a few KB; spread them, since a long list makes many.
    width = 2 * pairs.sparkSession.sparkContext.defaultParallelism
    within = pairs.repartition(width).mapInArrow(block_links, "a long, b long")
    return direct.union(within)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_entries: int = LIST_ENTRIES
) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (16 hex digits) and ``component_id``."""
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("held"))
    classes = stored(classes, "fingerprint-classes")
    linked = components(links(classes.where("rep is not null"), list_entries))
    named = classes.join(linked, classes["rep"] == linked["node"], "left")
    named = stored(named.select("fp", "held", F.coalesce("component", "rep").alias("component_id")), "fingerprint-names")
    return join_groups(prints, named, ["fp"], "held").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def signed_fingerprint(text: str | None) -> int:
    value = fingerprint(text)
    return value - (value >> 63 << 64)


def fingerprint_links(classes: DataFrame) -> DataFrame:
    """Links ``a, b`` of classes (``cls, fp``, stored; a class may have several): one fingerprint, or linked by the index."""
    prints = classes.groupBy("fp").agg(F.min("cls").alias("rep"), F.count("*").alias("held"))
    prints = stored(prints, "fingerprint-classes")
    same = join_groups(classes, prints, ["fp"], "held").where("cls <> rep")
    return same.select(F.col("rep").alias("a"), F.col("cls").alias("b")).unionByName(links(prints.select("fp", "rep")))


def _drop_by_fingerprint(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    numbered = with_row(docs, "__row")
    rows = numbered.select(F.struct(id_col, "__row").alias("id"), F.col(text_col).alias("text"))
    prints = stored(fingerprints(rows, "id").select(F.col(f"id.{id_col}").alias("id"), F.col("id.__row").alias("row"), "fp"), "fingerprints")
    # Rows whose id is null come after all others.
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row")).alias("first")
    classes = prints.groupBy("fp").agg(first, F.count("*").alias("held")).withColumn("rep", F.monotonically_increasing_id())
    classes = stored(classes, "fingerprint-classes")
    linked = stored(components(links(classes.select("fp", "rep"))), "fingerprint-components")
    named = classes.join(linked, classes["rep"] == linked["node"], "left")
    named = stored(named.select("fp", "held", "first", F.coalesce("component", "rep").alias("part")), "fingerprint-named")
    least = named.groupBy("part").agg(F.min("first").alias("least"), F.count("*").alias("classes"))
    names = join_groups(named, stored(least, "fingerprint-least"), ["part"], "classes")
    names = stored(names.select("fp", "held", F.col("least.row").alias("keep")), "fingerprint-names")
    dropped = join_groups(prints, names, ["fp"], "held").where(F.col("row") != F.col("keep")).select("row")
    return without_rows(numbered, stored(dropped, "near-dropped"), "__row")


def drop_near_duplicates(
    docs: DataFrame, settings: minhash.Settings | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each group of linked texts, that of the smallest id, with all its columns.

    Texts are linked as in ``near_duplicates``. With ``settings``, texts whose full sets reach its similarity are
    linked besides.
    """
    if settings is None:
        return _drop_by_fingerprint(docs, id_col, text_col)
    return minhash.drop_near_duplicates(docs, settings, id_col, text_col, signed_fingerprint, fingerprint_links)

"""Near-duplicates by b-bit MinHash (operator 13).

A text's set is that of its word shingles: lower case, cut at white space, compared by 64-bit hashes. Texts with the same
set are one class. A signature holds the low eight bits of ``ROWS`` minima for each of ``bands`` bands, packed into one
64-bit word per band. Classes that agree in a whole word meet in that band's list; their similarity is then estimated by
counting the signature's unequal bytes with bit operations, corrected for the one in 256 that agree by chance, and what may
reach the threshold is confirmed on the full sets. Two sets at similarity s meet with chance 1 - (1 - s^8)^bands (more by
chance agreement): 0.999997 at 0.85 with 40 bands, 0.999992 at 0.8 with 64. The estimate may be ``MARGIN`` standard
errors too low. These two chances are the only way for a link to be missed.

Links are found in two rounds, so that large groups cost neither a row per pair nor a task per group. First every class is held
against one other, the first class of the list that it shares the most bands with; links join classes into parts. Then
only lists that still hold several parts are looked at, in blocks of about ``BLOCK`` members, and of two members of the
same part or of the list's largest part nothing is asked. Tasks compare the signatures of two blocks and name the members that
may have a link; the sets of those are brought together, again in blocks, and tasks give back no more links than join the
parts they hold. A pair that shares several bands is looked at in the first of them. Nothing is capped.

Components are named by their smallest id. Texts without words are one class, or with ``link_empty=False`` linked with
nothing, not even each other. Rows that share an id are compared by their texts like any others. Rows whose id is null take
part and come after all others; a component of such rows only has a null name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import (
    BROADCAST_IDS,
    join_groups,
    join_hot,
    map_arrow,
    ship_package,
    stored,
    with_row,
    without_rows,
)
from kerbline.llm.components import components

SEED = 42
#: Minima of a band, and the bits that are kept of each: together one 64-bit word.
ROWS, BITS = 8, 8
#: Standard errors by which an estimate may fall short of the threshold.
MARGIN = 5
#: Members of a block of a list, and bytes of the sets of a block.
BLOCK = 256
BLOCK_BYTES = 4 << 20
#: Shingles whose minima are taken at once.
COUNTED = 1 << 10
#: Words a task remembers, and the longest of them in bytes.
MEMO_WORDS, MEMO_BYTES = 50_000, 64

TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Settings:
    """What counts as near: shingles of ``words`` words, a Jaccard similarity of at least ``similarity`` (a fraction)."""

    words: int = 5
    similarity: tuple[int, int] = (4, 5)
    bands: int = 64
    link_empty: bool = True

    @property
    def floor(self) -> float:
        """Least estimate of a pair that may reach the similarity."""
        s = self.similarity[0] / self.similarity[1]
        return s - MARGIN * math.sqrt(s * (1 - s) / (self.bands * ROWS))


def draws(bands: int) -> tuple[np.ndarray, np.ndarray]:
    """One flip and one odd factor per minimum."""
    random = np.random.default_rng(SEED)
    flips = random.integers(0, 1 << 32, bands * ROWS, np.uint32)
    return flips, random.integers(0, 1 << 32, bands * ROWS, np.uint32) | np.uint32(1)


# ---- sets and signatures ------------------------------------------------------------------------


class WordHashes(dict):
    """Hash by word, worked out on demand; long words are not remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = value
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * MIX
    return (values ^ (values >> np.uint64(32))) * MIX


def shingles(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text; a text of fewer words is one shingle."""
    found = (text or "").encode().translate(TO_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    span = min(words, len(found))
    count = len(found) - span + 1
    joined = np.full(count, span, np.uint64)
    for at in range(span):
        joined = joined * STEP + each[at : at + count]
    return np.unique(mixed(joined))


def signature(hashes: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A signed 64-bit word per band: the low bytes of its minima."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(flips), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(short), COUNTED):
        values = (short[None, at : at + COUNTED] ^ flips[:, None]) * factors[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return (least & np.uint32((1 << BITS) - 1)).astype(np.uint8).view(np.int64)


def signed_halves(data: bytes) -> tuple[int, int]:
    """A 128-bit digest as two signed longs."""
    whole = xxhash.xxh3_128_digest(data, SEED)
    return int.from_bytes(whole[:8], "big", signed=True), int.from_bytes(whole[8:], "big", signed=True)


#: A fingerprint of a whole text as a signed long, and the links ``a, b`` between classes (``cls, fp``) that follow from it.
Fingerprint = Callable[[str | None], int]
FurtherLinks = Callable[[DataFrame], DataFrame]


def signatures(docs: DataFrame, settings: Settings, fingerprint: Fingerprint | None = None) -> DataFrame:
    """``id, row, n, k1, k2, fp, packed`` per row of ``docs`` (``id, row, text``).

    That is the size and name of its set, the text's ``fingerprint`` (null without one) and its signature.
    """

    def work():
        known = WordHashes()
        flips, factors = draws(settings.bands)

        def compute(texts: pa.Array) -> list[pa.Array]:
            sizes, names, prints, packed = [], [], [], []
            for value in texts:
                text = value.as_py()
                hashes = shingles(text, settings.words, known)
                sizes.append(len(hashes))
                names.append(signed_halves(hashes.tobytes()))
                prints.append(fingerprint(text) if fingerprint else None)
                packed.append(signature(hashes, flips, factors) if len(hashes) else np.zeros(0, np.int64))
            columns = np.array(names, np.int64).reshape(-1, 2)
            halves = [pa.array(columns[:, i]) for i in range(2)]
            return [pa.array(sizes, pa.int64()), *halves, pa.array(prints, pa.int64()), pa.array(packed, pa.list_(pa.int64()))]

        return compute

    added = [T.StructField(name, T.LongType()) for name in ("n", "k1", "k2", "fp")]
    return map_arrow(docs, ["text"], ["id", "row"], [*added, T.StructField("packed", T.ArrayType(T.LongType()))], work)


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``cls, hashes`` of the classes of ``wanted`` (``cls, row``), from the texts of those rows."""
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.select("row", "text").join(wanted, "row").select("cls", "text")

    def work():
        known = WordHashes()

        def compute(texts: pa.Array) -> list[pa.Array]:
            made = [shingles(text.as_py(), words, known).view(np.int64) for text in texts]
            return [pa.array(made, pa.list_(pa.int64()))]

        return compute

    return stored(map_arrow(texts, ["text"], ["cls"], [T.StructField("hashes", T.ArrayType(T.LongType()))], work), "minhash-sets")


# ---- estimates ----------------------------------------------------------------------------------


def unequal_bytes(difference: Column) -> Column:
    """Bytes of a word that are not zero: their bits are folded into one each, and these are counted."""
    folded = difference
    for shift in (4, 2, 1):
        folded = folded.bitwiseOR(F.shiftrightunsigned(folded, shift))
    return F.bit_count(folded.bitwiseAND(F.lit(0x0101010101010101)))


def estimate(a: Column, b: Column, bands: int) -> Column:
    """Similarity of the sets of two signatures, corrected for bytes that agree by chance."""
    differences = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    unequal = F.aggregate(differences, F.lit(0), lambda total, word: total + unequal_bytes(word))
    chance = 1 / (1 << BITS)
    return ((1 - unequal / (bands * ROWS)) - chance) / (1 - chance)


def of_like_size(a, b, similarity: tuple[int, int]):
    """Sets of sizes further apart than the similarity cannot reach it."""
    part, whole = similarity
    return (whole * a >= part * b) & (whole * b >= part * a)


def similar(shared, a, b, similarity: tuple[int, int]):
    """Whether sets of ``a`` and ``b`` members that share some reach the similarity."""
    part, whole = similarity
    return whole * shared >= part * (a + b - shared)


# ---- blocks -------------------------------------------------------------------------------------


def nested(column: pa.ListArray, row: int, field: str) -> pa.Array:
    """The values of a field of a list of structs, for one row."""
    return column[row].values.field(field)


def ragged(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list array one after another, and the length of each list."""
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)


def live_members(settings: Settings):
    """Names the members of two blocks that may have a link to a member of another part."""
    chance, wanted = 1 / (1 << BITS), settings.bands * ROWS

    def side(batch: pa.RecordBatch, row: int, name: str):
        column = batch.column(name)
        keys, sizes, parts = (nested(column, row, f).to_numpy(zero_copy_only=False) for f in ("cls", "n", "part"))
        words = ragged(nested(column, row, "packed"))[0].reshape(len(keys), settings.bands)
        return keys, sizes, parts, words, words.view(np.uint8)

    def run(batches):
        for batch in batches:
            lists, found = [], []
            for row in range(batch.num_rows):
                name, band = batch.column("list")[row].as_py(), batch.column("band")[row].as_py()
                keys_a, sizes_a, parts_a, words_a, bytes_a = side(batch, row, "a")
                keys_b, sizes_b, parts_b, words_b, bytes_b = side(batch, row, "b")
                live = np.zeros(len(keys_b), bool)
                for i in range(len(keys_a)):
                    open_ = np.flatnonzero((parts_b != parts_a[i]) & of_like_size(sizes_b, sizes_a[i], settings.similarity))
                    if not len(open_):
                        continue
                    # A pair is looked at in the first band that it shares.
                    open_ = open_[(words_b[open_] == words_a[i]).argmax(axis=1) == band]
                    share = (bytes_b[open_] == bytes_a[i]).sum(axis=1) / wanted
                    open_ = open_[(share - chance) / (1 - chance) >= settings.floor]
                    if len(open_):
                        live[open_] = True
                        found.append(int(keys_a[i]))
                        lists.append(name)
                found += keys_b[live].tolist()
                lists += [name] * int(live.sum())
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), pa.array(found, pa.int64())], names=["list", "cls"])

    return run


def shared_counts(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]):
    """Per set of ``a``, the number of members it shares with each set of ``b``; sets are not empty."""
    (values_a, sizes_a), (values_b, sizes_b) = a, b
    kinds, places = np.unique(np.concatenate([values_a, values_b]), return_inverse=True)
    own, others = places[: len(values_a)], places[len(values_a) :]
    ends, starts_b = np.cumsum(sizes_a), np.cumsum(sizes_b) - sizes_b
    marks = np.zeros(len(kinds), np.int64)
    for start, end in zip(ends - sizes_a, ends, strict=True):
        marks[own[start:end]] = 1
        yield np.add.reduceat(marks[others], starts_b)
        marks[own[start:end]] = 0


def joining_links(settings: Settings):
    """Confirmed links between members of two blocks, no more than join the parts."""

    def run(batches):
        for batch in batches:
            out_a, out_b = [], []
            for row in range(batch.num_rows):
                a, b = (batch.column(name) for name in "ab")
                keys_a, parts_a = nested(a, row, "cls").to_pylist(), nested(a, row, "part").to_pylist()
                keys_b, parts_b = nested(b, row, "cls").to_pylist(), nested(b, row, "part").to_numpy(zero_copy_only=False)
                sets_a, sets_b = ragged(nested(a, row, "hashes")), ragged(nested(b, row, "hashes"))
                root: dict[int, int] = {}

                def find(node: int, root=root) -> int:
                    while root.setdefault(node, node) != node:
                        root[node] = node = root[root[node]]
                    return node

                for i, shared in enumerate(shared_counts(sets_a, sets_b)):
                    near = (parts_b != parts_a[i]) & similar(shared, sets_a[1][i], sets_b[1], settings.similarity)
                    for j in np.flatnonzero(near).tolist():
                        left, right = find(parts_a[i]), find(int(parts_b[j]))
                        if left != right:
                            root[left] = right
                            out_a.append(keys_a[i])
                            out_b.append(keys_b[j])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def block_pairs(members: DataFrame, fields: list[str], name: str) -> DataFrame:
    """``list, band, a, b``: pairs of blocks of a list, but for two blocks of its largest part.

    ``members`` has ``list, band, largest`` (whether the member is of the list's largest part), ``blocks`` (how many
    blocks the list is dealt to) and ``fields``.
    """
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")) * 2 + F.col("largest").cast("int")
    held = members.withColumn("block", block).groupBy("list", "band", "block")
    held = stored(held.agg(F.collect_list(F.struct(*fields)).alias("held")), name)
    left = held.select("list", "band", F.col("block").alias("x"), F.col("held").alias("a"))
    right = held.select("list", "band", F.col("block").alias("y"), F.col("held").alias("b"))
    pairs = left.join(right, ["list", "band"]).where("x <= y and not (x % 2 = 1 and y % 2 = 1)").drop("x", "y")
    ship_package(pairs.sparkSession)
    # A row carries two blocks; spread them, since a long list makes many.
    return pairs.repartition(2 * pairs.sparkSession.sparkContext.defaultParallelism)


# ---- links --------------------------------------------------------------------------------------


def confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Those of ``pairs`` (``a, b``, stored; each ``b`` in few pairs) whose full sets reach the similarity."""
    theirs = sets.withColumnsRenamed({"cls": "b", "hashes": "hashes_b"})
    ours = sets.withColumnsRenamed({"cls": "a", "hashes": "hashes_a"})
    rows = join_hot(pairs, ours, ["a"]).join(theirs, "b")
    shared = F.size(F.array_intersect("hashes_a", "hashes_b"))
    return rows.where(similar(shared, F.size("hashes_a"), F.size("hashes_b"), settings.similarity)).select("a", "b")


def links(classes: DataFrame, docs: DataFrame, settings: Settings, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` between classes (``cls, n, packed, row``), enough to connect all that are linked."""
    entries = classes.select("cls", F.posexplode("packed").alias("band", "word"))
    entries = entries.select(F.xxhash64("band", "word").alias("list"), "band", "cls")
    lists = entries.groupBy("list", "band").agg(F.count("*").alias("size"), F.min("cls").alias("hub"))
    lists = stored(lists.where("size > 1"), "minhash-lists")
    entries = stored(join_groups(entries, lists, ["list", "band"], "size"), "minhash-entries")

    # First round: every class and the hub that it shares the most bands with.
    met = entries.where("cls <> hub").groupBy(F.col("cls").alias("b"), F.col("hub").alias("a")).count()
    best = met.groupBy("b").agg(F.max(F.struct("count", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    best = stored(best, "minhash-best")
    sides = classes.select("cls", "n", "packed")
    rows = join_hot(best, sides.toDF("a", "n_a", "packed_a"), ["a"]).join(sides.toDF("b", "n_b", "packed_b"), "b")
    near = rows.where(of_like_size(F.col("n_a"), F.col("n_b"), settings.similarity))
    near = near.where(estimate(F.col("packed_a"), F.col("packed_b"), settings.bands) >= settings.floor)
    near = stored(near.select("a", "b"), "minhash-near")
    wanted = entries.select("cls").distinct()
    wanted = wanted.join(classes.select("cls", "row"), "cls")
    sets = full_sets(docs, stored(wanted, "minhash-wanted"), settings.words)
    first = stored(confirmed(near, sets, settings), "minhash-links")

    # Second round: lists that hold several parts.
    joined = stored(components(first), "minhash-joined")
    parts = entries.join(joined, entries["cls"] == joined["node"], "left")
    parts = stored(parts.select("list", "band", "cls", F.coalesce("component", "cls").alias("part")), "minhash-parts")
    by_part = parts.groupBy("list", "band", "part").agg(F.count("*").alias("members"))
    by_list = by_part.groupBy("list", "band").agg(
        F.count("*").alias("kinds"), F.sum("members").alias("size"), F.max(F.struct("members", "part")).alias("most")
    )
    mixed_lists = stored(by_list.where("kinds > 1").select("list", "band", "size", F.col("most.part").alias("main")), "minhash-mixed")
    if mixed_lists.isEmpty():
        return first
    members = join_groups(parts, mixed_lists, ["list", "band"], "size").withColumn("largest", F.col("part") == F.col("main"))
    members = stored(members.withColumn("blocks", F.ceil(F.col("size") / block)).drop("size", "main"), "minhash-members")
    signed = members.join(sides, "cls")
    pairs = block_pairs(signed, ["cls", "n", "part", "packed"], "minhash-blocks")
    live = stored(pairs.mapInArrow(live_members(settings), "list long, cls long").distinct(), "minhash-live")
    open_ = stored(members.drop("blocks").join(live, ["list", "cls"]).join(classes.select("cls", "n"), "cls"), "minhash-open")
    weights = open_.groupBy("list").agg(F.count("*").alias("size"), F.sum("n").alias("hashes"))
    blocks = F.ceil(F.greatest(F.col("size") / block, F.col("hashes") * 8 / BLOCK_BYTES))
    weights = stored(weights.withColumn("blocks", blocks).select("list", "size", "blocks"), "minhash-weights")
    weighed = join_groups(open_, weights, ["list"], "size").join(sets, "cls")
    pairs = block_pairs(weighed, ["cls", "part", "hashes"], "minhash-set-blocks")
    second = pairs.select("a", "b").mapInArrow(joining_links(settings), "a long, b long")
    return first.unionByName(stored(second.distinct(), "minhash-links"))


# ---- documents ----------------------------------------------------------------------------------


def marks(
    docs: DataFrame,
    settings: Settings,
    block: int = BLOCK,
    fingerprint: Fingerprint | None = None,
    further_links: FurtherLinks | None = None,
) -> DataFrame:
    """``id, row, n, component_id, keep`` per row of ``docs`` (``id, row, text``); ``keep`` is the row that stands for the component.

    With ``fingerprint`` and ``further_links``, classes are also linked by the fingerprints of their texts.
    """
    rows = stored(signatures(docs, settings, fingerprint), "minhash-signatures")
    spoken = rows if settings.link_empty else rows.where("n > 0")
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row")).alias("first")
    classes = spoken.groupBy("k1", "k2").agg(
        first, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("packed").alias("packed")
    )
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "minhash-classes")
    spoken_classes = classes.where("n > 0").select("cls", "n", "packed", F.col("first.row").alias("row"))
    found = links(spoken_classes, docs, settings, block)
    if further_links:
        # Texts of one set may differ in their fingerprints, which count repeats.
        prints = spoken.select("k1", "k2", "fp").distinct().join(classes.select("k1", "k2", "cls"), ["k1", "k2"])
        found = found.unionByName(further_links(stored(prints.select("cls", "fp"), "minhash-prints")))
    linked = stored(components(found), "minhash-components")
    named = classes.join(linked, classes["cls"] == linked["node"], "left")
    named = stored(named.select("k1", "k2", "copies", "first", F.coalesce("component", "cls").alias("part")), "minhash-named")
    least = named.groupBy("part").agg(F.min("first").alias("least"), F.count("*").alias("classes"))
    named = join_groups(named, stored(least, "minhash-least"), ["part"], "classes")
    named = stored(named.select("k1", "k2", "copies", "least"), "minhash-names")
    out = join_groups(spoken, named, ["k1", "k2"], "copies")
    out = out.select("id", "row", "n", F.col("least.id").alias("component_id"), F.col("least.row").alias("keep"))
    if settings.link_empty:
        return out
    return out.unionByName(rows.where("n = 0").select("id", "row", "n", F.col("id").alias("component_id"), F.col("row").alias("keep")))


def near_duplicates(
    docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles``, ``component_id`` and ``kept`` (its id names the component)."""
    rows = with_row(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "row")
    return marks(rows, settings, block).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame,
    settings: Settings = Settings(),
    id_col: str = "doc_id",
    text_col: str = "text",
    fingerprint: Fingerprint | None = None,
    further_links: FurtherLinks | None = None,
) -> DataFrame:
    """One row of each component (see ``marks``), that of the smallest id, with all its columns."""
    numbered = with_row(docs, "__row")
    rows = numbered.select(F.col(id_col).alias("id"), F.col("__row").alias("row"), F.col(text_col).alias("text"))
    marked = marks(rows, settings, fingerprint=fingerprint, further_links=further_links)
    dropped = marked.where(F.col("row") != F.col("keep")).select("row")
    return without_rows(numbered, stored(dropped, "near-dropped"), "__row")

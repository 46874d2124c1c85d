"""Exact dedup by content-defined chunk recipes (operator 7); DataFrame functions only.

A text is cut into words at white space. A chunk ends behind a word where its hash falls on a
fixed residue, and after ``MAX_WORDS`` words at the latest, so equal passages give equal chunks
wherever they stand. Chunks are de-duplicated to identifiers that are verified against the chunk's text: two
chunk texts that share a hash get different ranks. Texts are then compared by the ordered list of their chunk
identifiers, so that a long text is moved once, as chunks that were combined before the shuffle.

Two texts are equal when they are the same after each run of ``[\\x20\\x09-\\x0D]`` became one space; null counts as
empty. The row with the smallest id stays (``kept`` marks the rows that share this id; a null id stays only where its
group has no other). ``drop_exact_duplicates`` keeps exactly one row of each group, also among rows that share an id or
have none. A group may be of any size: it is counted with partial aggregates, and groups of more than one in
``common.HOT_SHARE`` of the rows are looked up by broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import join_groups, stored, with_row, without_rows

SPACES = r"[\x20\x09-\x0D]+"
#: Words of a chunk, on average (a power of two) and at most.
MEAN_WORDS = 128
MAX_WORDS = 1024

RESULT = ["keep_id", "group_size", "kept", "text_sha256"]


def words_of(text: Column) -> Column:
    """Words between white space; an empty first or last word stands for white space at that end."""
    return F.split(F.coalesce(text, F.lit("")), SPACES, -1)


def ends_of(words: Column) -> Column:
    """Word counts at which a chunk may end by content; the last is the number of words."""
    by_content = F.transform(
        words, lambda word, i: F.when(F.xxhash64(word).bitwiseAND(F.lit(MEAN_WORDS - 1)) == 0, i + 1)
    )
    return F.array_union(F.array_compact(by_content), F.array(F.size(words)))


def chunks_of(words: Column, ends: Column) -> Column:
    """Chunk texts in order; joined by single spaces they give the normalised text."""
    pieces = F.transform(
        ends,
        lambda end, number: F.transform(
            F.sequence(F.coalesce(F.get(ends, number - 1), F.lit(0)), end - 1, F.lit(MAX_WORDS)),
            lambda start: F.array_join(F.slice(words, start + 1, F.least(F.lit(MAX_WORDS), end - start)), " "),
        ),
    )
    return F.flatten(pieces)


def once(value: Column) -> Column:
    """``value`` as a generated row, so that later steps that use it several times do not work it out again."""
    return F.explode(F.array(F.struct(value.alias("is"))))


def cut(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, words, chunks`` per row."""
    rows = docs.select(F.col(id_col).alias("id"), once(words_of(F.col(text_col))).alias("made"))
    rows = rows.select("id", F.col("made.is").alias("words"))
    rows = rows.select("id", "words", once(ends_of(F.col("words"))).alias("made"))
    rows = rows.select("id", "words", F.col("made.is").alias("ends"))
    return rows.select("id", "words", chunks_of(F.col("words"), F.col("ends")).alias("chunks"))


def occurrences(rows: DataFrame, chunk_hash: Callable[[Column], Column]) -> DataFrame:
    pieces = rows.select("row", F.posexplode("chunks").alias("at", "chunk"))
    return pieces.select("row", "at", chunk_hash(F.col("chunk")).alias("hash"), "chunk")


def clashing(rows: DataFrame, chunk_hash: Callable[[Column], Column]) -> DataFrame:
    """Hashes that stand for more than one chunk text. All chunks are compared by their text."""
    distinct = occurrences(rows, chunk_hash).groupBy("hash", "chunk").count()
    return distinct.groupBy("hash").count().where(F.col("count") > 1).select("hash")


def recipes(
    docs: DataFrame, id_col: str, text_col: str, chunk_hash: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """``id, sha, ids, ranks`` per row: the ordered verified identifiers of the text's chunks.

    ``ids`` are the hashes of the chunks. ``ranks`` is empty unless a chunk's hash clashes; it then lists the
    positions of such chunks with the rank of their text among the texts of that hash.
    """
    sha = F.sha2(F.array_join("words", " "), 256).alias("sha")
    rows = cut(docs, id_col, text_col).select("id", sha, "chunks", F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "chunks")
    clash = stored(clashing(rows, chunk_hash), "chunk-clashes")
    ids = F.transform("chunks", lambda chunk: chunk_hash(chunk)).alias("ids")
    none = F.array().cast("array<struct<at:int,rank:int>>")
    if clash.isEmpty():
        return rows.select("id", "sha", ids, none.alias("ranks"))
    found = occurrences(rows, chunk_hash).join(clash, "hash")
    texts = found.select("hash", "chunk").distinct()
    ranked = texts.withColumn("rank", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")))
    ranks = found.join(ranked, ["hash", "chunk"]).groupBy("row")
    ranks = ranks.agg(F.sort_array(F.collect_list(F.struct("at", "rank"))).alias("ranks"))
    joined = rows.select("row", "id", "sha", ids).join(ranks, "row", "left")
    return joined.select("id", "sha", "ids", F.coalesce("ranks", none).alias("ranks"))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    rows = recipes(docs, id_col, text_col, chunk_hash)
    rows = stored(rows.withColumn("key", F.xxhash64("ids", "ranks")), "chunk-recipes")
    keys = ["key", "ids", "ranks"]
    groups = rows.groupBy(*keys).agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    joined = join_groups(rows, stored(groups, "chunk-groups"), keys, "group_size")
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each group, that of the smallest id (of the first row where ids are equal), with all its columns."""
    numbered = with_row(docs, "__row")
    order = F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col).alias("id"), F.col("__row").alias("row"))
    marks = exact_duplicates(numbered.select(order.alias("__order"), F.col(text_col).alias("__text")), "__order", "__text")
    dropped = marks.where(~F.col("kept")).select("__order.row")
    return without_rows(numbered, stored(dropped, "exact-dropped"), "__row")

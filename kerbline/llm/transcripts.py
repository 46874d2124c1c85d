"""Chat formatting: transcripts to canonical turns by a hidden Markov model (operator 1).

The lines of a conversation are the observations, the roles of their speakers the hidden states. A line shows a
speaker marker (``User:``, ``### Assistant``, ``<|system|>`` and the like, or none) and line features (question, length, list or
code, opening of a message); given the role these are independent. Emissions, the role of the first message and the
role of the next message given the last are counted over all labelled conversations; within a message the role
stays, except at a line with a marker, where any role may follow. Viterbi finds the most likely roles; runs of lines of one role within a message
become canonical turns, without their markers.

Conversations may be of any length. They are cut into blocks of ``BLOCK_TURNS`` turn numbers; a block of more than
``BLOCK_ROWS`` rows (turn numbers that repeat or are null) is cut again by the order of its rows. Each block is reduced to the
best score between every pair of roles at its ends (a matrix of nine numbers); those matrices, one row per block,
fix the roles at the ends of all blocks; then each block is decoded by itself. The result is that of Viterbi over the
whole conversation. Equal scores go to the role that is first in ``ROLES``.

A null text is an empty line. A null turn number counts as -1, and rows without a conversation id are one
conversation. Rows of the same conversation and turn are ordered by their text. Text moves once, by block; that of
blocks with too many rows moves once more, when they are sorted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import map_arrow, ship_package, stored

ROLES = ("system", "user", "assistant")
BLOCK_TURNS = 512
BLOCK_ROWS = 1024
#: Pseudo-counts: of every value of a line feature, of a marker that names the role, and of one that names another.
SMOOTHING = 0.5
OWN_MARKER = 20.0
OTHER_MARKER = 1e-4
#: Chance that the role changes between two lines of a message if the second has no marker; with one any role may follow.
CHANGE_WITHIN = 1e-4

NAMES = {
    "system": "system|instructions?|context",
    "user": "user|human|customer|question|prompt|q",
    "assistant": "assistant|bot|ai|model|agent|answer|response|a",
}
#: A speaker marker at the start of a line: a name with a colon, or in brackets or behind hashes.
MARKERS = {
    role: re.compile(
        rf"\s*(?:<\|(?:im_start\|>)?\s*(?:{names})(?:\|>)?|\[(?:{names})\]|\#+\s*(?:{names})\s*:?|\*\*(?:{names})\s*:?\*\*:?|(?:{names})\s*:)\s*",
        re.IGNORECASE,
    )
    for role, names in NAMES.items()
}
LISTED = re.compile(r"\s*(?:[-*•]|\d+[.)]|```|    )")
#: Number of values of each feature of a line: marker, question, length, list or code, opening.
SIZES = (len(ROLES) + 1, 2, 3, 2, 2)
MARKER_BASE = int(np.prod(SIZES[1:]))


def marker_of(line: str) -> tuple[int, int]:
    """Number of the role that a marker names (or the number of roles), and where the text behind it starts."""
    for number, role in enumerate(ROLES):
        if found := MARKERS[role].match(line):
            return number, found.end()
    return len(ROLES), 0


def observe(text: str | None) -> list[int]:
    """One number per line of a message; its digits to the bases ``SIZES`` are the features."""
    codes = []
    for i, line in enumerate((text or "").split("\n")):
        size = len(line)
        features = (
            marker_of(line)[0],
            int(line.rstrip().endswith("?")),
            (size > 40) + (size > 160),
            int(bool(LISTED.match(line))),
            int(i == 0),
        )
        code = 0
        for value, base in zip(features, SIZES, strict=True):
            code = code * base + value
        codes.append(code)
    return codes


def features_of(code: int) -> list[int]:
    values = []
    for base in reversed(SIZES):
        code, value = divmod(code, base)
        values.append(value)
    return values[::-1]


@dataclass
class Model:
    """Log chances: of the first role, of the next message's role, of the next line's, and of each line code by role."""

    first: np.ndarray
    between: np.ndarray
    within: np.ndarray
    marked: np.ndarray
    emit: np.ndarray


def model_of(first: np.ndarray, between: np.ndarray, features: list[np.ndarray]) -> Model:
    """From counts: by role, by role and next role, and by role and value of each feature."""
    roles = len(ROLES)
    stay = np.full((roles, roles), CHANGE_WITHIN / (roles - 1))
    np.fill_diagonal(stay, 1 - CHANGE_WITHIN)
    logs = []
    for number, counts in enumerate(features):
        counts = counts + (SMOOTHING if number else OTHER_MARKER)
        if number == 0:
            counts[np.arange(roles), np.arange(roles)] += OWN_MARKER
            counts[:, roles] += SMOOTHING
        logs.append(np.log(counts / counts.sum(axis=1, keepdims=True)))
    codes = [features_of(code) for code in range(int(np.prod(SIZES)))]
    emit = np.array([sum(log[:, value] for log, value in zip(logs, values, strict=True)) for values in codes])
    first, between = first + SMOOTHING, between + SMOOTHING
    return Model(np.log(first / first.sum()), np.log(between / between.sum(axis=1, keepdims=True)), np.log(stay), np.full((roles, roles), -np.log(roles)), emit)


# ---- fitting ------------------------------------------------------------------------------------


def turn_of(turn_col: str) -> Column:
    return F.coalesce(F.col(turn_col), F.lit(-1)).cast("long")


def block_of(turn: Column) -> Column:
    return F.floor(turn / BLOCK_TURNS).cast("long")


def observed(chats: DataFrame, conv_col: str, turn_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """``conv, turn, text, block``, the columns ``keep``, and ``codes`` of each message's lines."""
    rows = chats.select(
        F.col(conv_col).alias("conv"),
        turn_of(turn_col).alias("turn"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *(F.col(f"`{name}`") for name in keep),
    )

    def work():
        def compute(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([observe(text) for text in texts.to_pylist()], pa.list_(pa.int32()))]

        return compute

    added = [T.StructField("codes", T.ArrayType(T.IntegerType()))]
    rows = map_arrow(rows, ["text"], rows.columns, added, work)
    return rows.withColumn("block", block_of(F.col("turn")))


def fit(
    chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role"
) -> Model:
    """Counts over all rows of ``chats`` whose role is one of ``ROLES``; a few dozen numbers come back."""
    known = chats.where(F.col(role_col).isin(*ROLES)).withColumn("__role", F.array_position(F.array(*map(F.lit, ROLES)), F.col(role_col)) - 1)
    rows = stored(observed(known, conv_col, turn_col, text_col, ["__role"]).drop("text"), "chat-codes")
    size = len(ROLES)
    features = [np.zeros((size, values)) for values in SIZES]
    lines = rows.select("__role", F.explode("codes").alias("code")).groupBy("__role", "code").count()
    for role, code, count in lines.collect():
        for counts, value in zip(features, features_of(code), strict=True):
            counts[role, value] += count
    turns = rows.groupBy("conv", "turn").agg(F.min("__role").alias("own"))
    starts = turns.groupBy("conv").agg(F.min(F.struct("turn", "own")).alias("opening"))
    first, between = np.zeros(size), np.zeros((size, size))
    for role, count in starts.groupBy("opening.own").count().collect():
        first[role] = count
    following = turns.select("conv", (F.col("turn") - 1).alias("turn"), F.col("own").alias("next"))
    for role, after, count in turns.join(following, ["conv", "turn"]).groupBy("own", "next").count().collect():
        between[role, after] = count
    return model_of(first, between, features)


# ---- decoding -----------------------------------------------------------------------------------


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Rows of one key after the other, from batches that are sorted by the keys."""
    group, current = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[name] for name in keys)
            if group and key != current:
                yield group
                group = []
            current = key
            group.append(row)
    if group:
        yield group


def steps_of(model: Model, messages: list[list[int]], opens: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Transition matrix and emissions of each line; the first line of a conversation starts from any state alike."""
    for number, codes in enumerate(messages):
        for i, code in enumerate(codes):
            if i:
                change = model.marked if code // MARKER_BASE < len(ROLES) else model.within
            elif opens and number == 0:
                change = np.broadcast_to(model.first, model.between.shape)
            else:
                change = model.between
            yield change, model.emit[code]


def block_matrix(model: Model, messages: list[list[int]], opens: bool) -> np.ndarray:
    """Best score from each role in front of the block to each role at its last line."""
    size = len(ROLES)
    best = np.where(np.eye(size, dtype=bool), 0.0, -np.inf)
    for change, emit in steps_of(model, messages, opens):
        best = (best[:, :, None] + change[None]).max(axis=1) + emit
    return best


def block_roles(model: Model, messages: list[list[int]], opens: bool, before: int, last: int) -> list[int]:
    """Most likely roles of all lines of a block, from role ``before`` in front of it to role ``last`` (-1: any) at its end."""
    score = np.full(len(ROLES), -np.inf)
    score[before] = 0.0
    back = []
    for change, emit in steps_of(model, messages, opens):
        paths = score[:, None] + change
        back.append(paths.argmax(axis=0))
        score = paths.max(axis=0) + emit
    role = int(score.argmax()) if last < 0 else last
    roles = []
    for came_from in reversed(back):
        roles.append(role)
        role = int(came_from[role])
    return roles[::-1]


def block_ends(blocks: pd.DataFrame) -> pd.DataFrame:
    """Roles in front and at the end of each block of one conversation, from the blocks' matrices."""
    blocks = blocks.sort_values(["block", "sub"], kind="stable")
    size = len(ROLES)
    score, back = np.array([0.0] + [-np.inf] * (size - 1)), []
    for matrix in blocks["matrix"]:
        paths = score[:, None] + np.array(matrix, float).reshape(size, size)
        back.append(paths.argmax(axis=0))
        score = paths.max(axis=0)
    role, before, last = int(score.argmax()), [], []
    for came_from in reversed(back):
        last.append(role)
        role = int(came_from[role])
        before.append(role)
    return pd.DataFrame({"conv": blocks["conv"], "block": blocks["block"], "sub": blocks["sub"], "before": before[::-1], "last": last[::-1]})



def turns_of(text: str, roles: list[int]) -> list[tuple[str, str]]:
    """Role and text of each run of lines of one role; a marker is removed where it names that role."""
    turns: list[tuple[int, list[str]]] = []
    for line, role in zip(text.split("\n"), roles, strict=True):
        named, start = marker_of(line)
        if not turns or turns[-1][0] != role:
            turns.append((role, []))
        turns[-1][1].append(line[start:] if named == role else line)
    return [(ROLES[role], "\n".join(lines).strip()) for role, lines in turns]


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of a block together and in order."""
    return rows.repartition("conv", "block", "sub").sortWithinPartitions("conv", "block", "sub", "turn", "text")


def cut_by_rows(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``keys`` (their ``conv, block``) with ``sub``, so that no ``conv, block, sub`` has over ``BLOCK_ROWS`` rows.

    Rows of too large blocks are sorted over all tasks, equal ones too; each task numbers stretches of its rows. The
    numbers follow the order of the rows.
    """
    limit = BLOCK_ROWS
    large = keys.groupBy("conv", "block").count().where(F.col("count") > limit)
    large = stored(large.select(F.col("conv").alias("large_conv"), F.col("block").alias("large_block")), "large-blocks")
    # At most one in ``BLOCK_ROWS`` rows.
    there = F.col("conv").eqNullSafe(F.col("large_conv")) & (F.col("block") == F.col("large_block"))
    first = F.lit(0).cast("long")
    if large.isEmpty():
        return rows.withColumn("sub", first), keys.withColumn("sub", first)
    large = F.broadcast(large)
    held = rows.join(large, there, "left_semi").withColumn("__tie", F.monotonically_increasing_id())
    order = ["conv", "block", "turn", "text", "__tie"]
    held = held.repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie")

    def number(batches):
        current, count, stretch = None, 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            subs = []
            for key in zip(batch.column("conv").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if key != current or count == limit:
                    current, count, stretch = key, 0, stretch + 1
                count += 1
                subs.append(stretch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(subs, pa.int64())], names=[*batch.schema.names, "sub"])

    schema = T.StructType([*held.schema.fields, T.StructField("sub", T.LongType())])
    held = stored(held.mapInArrow(number, schema), "cut-chats")
    rest, others = (df.join(large, there, "left_anti").withColumn("sub", first) for df in (rows, keys))
    return rest.unionByName(held), others.unionByName(held.select("conv", "block", "sub"))


def format_chats(
    chats: DataFrame, model: Model, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text"
) -> DataFrame:
    """``conv_col, turn_col, part, role, content, rendered``: the turns recovered from each message, in order."""
    spark = chats.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    keys = chats.select(F.col(conv_col).alias("conv"), block_of(turn_of(turn_col)).alias("block"))
    rows, keys = cut_by_rows(observed(chats, conv_col, turn_col, text_col, []), keys)
    place = F.struct("block", "sub")
    blocks = keys.groupBy("conv").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # Only conversations of several blocks need the first pass.
    several = blocks.where("first < last").select("conv", F.col("first.block").alias("first_block"), F.col("first.sub").alias("first_sub"))
    several = stored(several, "long-chats")
    conv_type = rows.schema["conv"].dataType

    def matrices(batches):
        for group in sorted_groups(batches, ["conv", "block", "sub"]):
            opens = (group[0]["block"], group[0]["sub"]) == (group[0]["first_block"], group[0]["first_sub"])
            matrix = block_matrix(shared.value, [row["codes"] for row in group], opens)
            one = {name: [group[0][name]] for name in ("conv", "block", "sub")} | {"matrix": [matrix.ravel().tolist()]}
            yield pa.RecordBatch.from_pydict(one, schema=matrix_arrow)

    matrix_schema = T.StructType(
        [
            T.StructField("conv", conv_type),
            T.StructField("block", T.LongType()),
            T.StructField("sub", T.LongType()),
            T.StructField("matrix", T.ArrayType(T.DoubleType())),
        ]
    )
    arrow_conv = pa.string() if conv_type == T.StringType() else pa.int32() if conv_type == T.IntegerType() else pa.int64()
    matrix_arrow = pa.schema([("conv", arrow_conv), ("block", pa.int64()), ("sub", pa.int64()), ("matrix", pa.list_(pa.float64()))])
    long_rows = rows.join(several, rows["conv"].eqNullSafe(several["conv"])).drop(several["conv"])
    made = in_blocks(long_rows.select("conv", "block", "sub", "turn", "text", "codes", "first_block", "first_sub")).mapInArrow(matrices, matrix_schema)
    ends_schema = T.StructType([*matrix_schema.fields[:3], T.StructField("before", T.IntegerType()), T.StructField("last", T.IntegerType())])
    ends = stored(made.groupBy("conv").applyInPandas(block_ends, ends_schema), "chat-ends")

    def decode(batches):
        for group in sorted_groups(batches, ["conv", "block", "sub"]):
            head = group[0]
            opens = head["before"] is None or (head["block"], head["sub"]) == (head["first_block"], head["first_sub"])
            before, last = (0, -1) if head["before"] is None else (head["before"], head["last"])
            roles = block_roles(shared.value, [row["codes"] for row in group], opens, before, last)
            out = {name: [] for name in ("conv", "turn", "part", "role", "content")}
            at = 0
            for row in group:
                size = len(row["codes"])
                for part, (role, content) in enumerate(turns_of(row["text"], roles[at : at + size])):
                    for name, value in zip(out, (row["conv"], row["turn"], part, role, content), strict=True):
                        out[name].append(value)
                at += size
            yield pa.RecordBatch.from_pydict(out, schema=turn_arrow)

    turn_arrow = pa.schema([("conv", arrow_conv), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("content", pa.string())])
    turn_schema = T.StructType(
        [
            T.StructField("conv", conv_type),
            T.StructField("turn", T.LongType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("role", T.StringType()),
            T.StructField("content", T.StringType()),
        ]
    )
    first_blocks = several.select(F.col("conv").alias("long_conv"), "first_block", "first_sub")
    known_ends = ends.join(first_blocks, F.col("conv").eqNullSafe(F.col("long_conv")))
    ends_of = {"end_conv": "conv", "end_block": "block", "end_sub": "sub"}
    known_ends = known_ends.select(
        *(F.col(name).alias(end) for end, name in ends_of.items()), "before", "last", "first_block", "first_sub"
    )
    same = F.col("conv").eqNullSafe(F.col("end_conv")) & (F.col("block") == F.col("end_block")) & (F.col("sub") == F.col("end_sub"))
    joined = rows.join(known_ends, same, "left").drop(*ends_of)
    turns = in_blocks(joined).mapInArrow(decode, turn_schema)
    return turns.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        "part",
        "role",
        "content",
        F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content", F.lit("\n<|end|>")).alias("rendered"),
    )

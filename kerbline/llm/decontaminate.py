"""Benchmark decontamination by pigeonhole edit matching (operator 5).

Texts and test items are lower-cased and runs of white space become one space. An item of ``m`` characters has an
error budget of ``k = m * ERROR_RATE`` edits and is split into ``k + 1`` pieces, so that any passage within the budget
holds at least one piece unchanged. All pieces are found in one pass over a text by an Aho-Corasick automaton.
A hit is verified with Myers' bit-parallel edit distance, from small to large: a node of the binary tree over the
pieces that covers ``j`` of them may have ``j - 1`` errors (if a node is within its budget, one of its halves is), so most
chance hits end at the first pair of pieces; the root is the whole item within its whole budget.

Documents are read whole, in place, without a shuffle. Test items are the stated query set: they are stored once and go
to the tasks in blocks of about ``BLOCK_CHARS`` characters, each with one automaton of bounded size. Documents pass through
``BLOCKS_AT_ONCE`` blocks at a time, so the driver and the tasks never hold more of the items than that; if there are
more, the documents are stored in between.

Null and empty texts hold no passage, and null and empty items are in no text. Items shorter than ``MIN_CHARS`` after
normalisation are searched verbatim and have to begin and end at a word's border, since few edits make another word of
them. Repeated items are reported under each of their ids, items without an id under a null id. Ids may be of any type.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kerbline.llm.common import map_arrow, stored

ERROR_RATE = 0.1
MIN_CHARS = 20
BLOCK_CHARS = 500_000
BLOCKS_AT_ONCE = 8


def leaks_type(id_type: T.DataType) -> T.ArrayType:
    names = ["distance", "start", "end"]
    return T.ArrayType(T.StructType([T.StructField("item_id", id_type), *(T.StructField(name, T.IntegerType()) for name in names)]))


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def masks_of(pattern: str) -> dict[str, int]:
    """Per character, the bits of its positions."""
    masks: dict[str, int] = defaultdict(int)
    for i, char in enumerate(pattern):
        masks[char] |= 1 << i
    return dict(masks)


def closest(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to a passage of ``text``, and the first end where it is reached."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, distance = full, 0, size
    best, best_end = size, 0
    for i, char in enumerate(text):
        equal = masks.get(char, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, down = up << 1, down << 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if distance < best:
            best, best_end = distance, i + 1
    return best, best_end


@dataclass
class Node:
    """Pieces ``[first, last)`` of an item: characters ``[start, end)``, at most ``last - first - 1`` errors."""

    start: int
    end: int
    budget: int
    masks: dict[str, int]


@dataclass
class Item:
    item_id: object
    text: str
    budget: int
    verbatim: bool = False
    bounds: list[int] = field(init=False)
    nodes: dict[tuple[int, int], Node] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        pieces = self.budget + 1
        self.bounds = [len(self.text) * i // pieces for i in range(pieces + 1)]

    def pieces(self) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.bounds, self.bounds[1:], strict=False)]

    def node(self, first: int, last: int) -> Node:
        made = self.nodes.get((first, last))
        if made is None:
            start, end = self.bounds[first], self.bounds[last]
            made = self.nodes[first, last] = Node(start, end, last - first - 1, masks_of(self.text[start:end]))
        return made

    def path(self, piece: int) -> list[tuple[int, int]]:
        """Nodes above a piece, from its parent to the root."""
        first, last, above = 0, self.budget + 1, []
        while last - first > 1:
            above.append((first, last))
            middle = (first + last) // 2
            first, last = (first, middle) if piece < middle else (middle, last)
        return above[::-1]

    def verify(self, text: str, at: int, piece: int) -> tuple[int, int, int] | None:
        """``distance, start, end`` of the item near the hit of ``piece`` at ``at``; None beyond the budget."""
        start, end, distance = at, at + self.bounds[piece + 1] - self.bounds[piece], 0
        if self.verbatim and (text[start - 1 : start].isalnum() or text[end : end + 1].isalnum()):
            return None
        for first, last in self.path(piece):
            node = self.node(first, last)
            low = max(0, at - (self.bounds[piece] - node.start) - node.budget)
            high = at + node.end - self.bounds[piece] + node.budget
            distance, stop = closest(node.masks, node.end - node.start, text[low:high])
            if distance > node.budget:
                return None
            start, end = low, low + stop
        if distance:
            # The same search backwards from the end gives the start.
            reverse = self.text[::-1]
            _, length = closest(masks_of(reverse), len(reverse), text[start:end][::-1])
            return distance, end - length, end
        return 0, end - len(self.text), end


class Matcher:
    """One automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float) -> None:
        self.items = []
        owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for place, (item_id, text) in enumerate(items):
            short = len(text) < MIN_CHARS
            self.items.append(Item(item_id, text, 0 if short else int(len(text) * error_rate), short))
            for number, piece in enumerate(self.items[-1].pieces()):
                owners[piece].append((place, number))
        self.automaton = ahocorasick.Automaton()
        for piece, found in owners.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def leaks(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """``item_id, distance, start, end`` of the first verified passage of each item."""
        text = normalised(text)
        if self.empty or not text:
            return []
        found: dict[int, tuple[object, int, int, int]] = {}
        for last, (size, owners) in self.automaton.iter(text):
            at = last - size + 1
            for place, number in owners:
                if place not in found and (match := self.items[place].verify(text, at, number)):
                    found[place] = (self.items[place].item_id, *match)
        return [found[place] for place in sorted(found)]


def item_blocks(items: DataFrame, block_chars: int) -> list[DataFrame]:
    """The items (``id, text``, stored) in blocks of bounded size; none of them is read here."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // block_chars))
    return [items.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == number) for number in range(count)]


def read_block(block: DataFrame) -> list[tuple[object, str]]:
    texts = dict.fromkeys((row.id, normalised(row.text)) for row in block.toLocalIterator())
    return sorted((pair for pair in texts if pair[1]), key=lambda pair: (pair[0] is not None, pair))


def mark_leaks(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    leaks_col: str = "leaks",
    keep: list[str] | None = None,
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    error_rate: float = ERROR_RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``keep`` (all columns by default) and ``leaks_col``: one entry per test item found in the text.

    ``start`` and ``end`` are offsets in the normalised text, of the first passage that was verified.
    """
    keep = [name for name in (docs.columns if keep is None else keep) if name != leaks_col]
    context = docs.sparkSession.sparkContext
    columns = list(dict.fromkeys([*keep, text_col]))
    rows = items.select(F.col(item_id_col).alias("id"), F.col(item_text_col).alias("text"))
    blocks = item_blocks(stored(rows, "test-items"), block_chars)
    kind = leaks_type(items.schema[item_id_col].dataType)
    arrow_kind, names = to_arrow_type(kind), kind.elementType.names
    marked, parts = docs.select(*columns), []
    for number, block in enumerate(blocks):
        if number and number % BLOCKS_AT_ONCE == 0:
            marked = stored(marked, "partly-marked")
        shared = context.broadcast(read_block(block))

        def work(shared=shared):
            matcher = Matcher(shared.value, error_rate)

            def compute(texts: pa.Array) -> list[pa.Array]:
                found = [[dict(zip(names, leak, strict=True)) for leak in matcher.leaks(text.as_py())] for text in texts]
                return [pa.array(found, arrow_kind)]

            return compute

        parts.append(f"__leaks_{number}")
        marked = map_arrow(marked, [text_col], [*columns, *parts[:-1]], [T.StructField(parts[-1], kind)], work)
    return marked.select(*keep, F.array_sort(F.concat(*parts)).alias(leaks_col))


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no test item, with all their columns."""
    return mark_leaks(docs, items, text_col, "__leaks").where(F.size("__leaks") == 0).drop("__leaks")

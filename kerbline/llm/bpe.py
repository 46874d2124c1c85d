"""Byte-level BPE encoding and decoding (operator 10).

A text is cut into pre-tokens by the tokenizer's pattern. Each pre-token is looked up in two tiers: a minimal
perfect hash over the vocabulary resolves those that are one token; the others are merged over a linked list of
bytes, lowest rank first and leftmost among equals: short ones many at a time, side by side in the rows of a table,
long ones with a heap of candidate pairs. Tasks remember the pre-tokens they have seen lately, up to a fixed count.

Texts are read whole, in Arrow batches, without a shuffle. Null counts as empty. Encoded ids are stored as
little-endian unsigned 32-bit integers in one binary value.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kerbline.llm.common import map_arrow

#: Pre-tokens a task remembers, in two halves, and the characters of the longest; a few dozen MB.
MEMO_ENTRIES = 100_000
MEMO_CHARS = 64
#: Bytes of the longest pre-token that is merged side by side with others, and how many are at once.
COLUMNS = 32
ROWS = 4_096
#: Stands for the rank of a pair that makes no token.
NO_RANK = np.iinfo(np.int64).max
#: Characters of texts that are cut into pre-tokens before they are looked up; a longer text is taken by itself.
PART_CHARS = 1 << 18

#: Letters of the Latin blocks up to U+02AF. In texts of only these, ASCII and general punctuation, the
#: tokenizer's classes can be written without Unicode properties, which the faster engine understands.
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
NOT_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-±´¶-¸»¿-ʯ‐-‧]")
PLAIN_PATTERN = re.compile(
    rf" ?[{LATIN}]++|'(?:[stmd]|re|ve|ll)| ?[0-9]++| ?[^\s{LATIN}0-9]++|\s+(?!\S)|\s+"
)
#: The pattern that ``PLAIN_PATTERN`` stands for; other patterns always take the general engine.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass
class PerfectHash:
    """Minimal perfect hash by displacement: as many slots as keys, one probe per lookup.

    Keys fall into buckets; the displacement of a bucket moves all its keys to free slots. A bucket of one key
    names its slot directly (as a negative number). A key outside the set also gets a slot, so the stored key
    is compared.
    """

    keys: list[bytes]
    values: list[int]
    displacements: list[int]

    @classmethod
    def build(cls, entries: dict[bytes, int]) -> PerfectHash:
        size, n_buckets = len(entries), max(1, len(entries) // 2)
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(n_buckets)]
        for key in sorted(entries):
            code = xxhash.xxh3_128_intdigest(key)
            buckets[code % n_buckets].append((code, key))
        slots: list[bytes | None] = [None] * size
        displacements = [0] * n_buckets
        order = sorted(range(n_buckets), key=lambda b: -len(buckets[b]))
        free = None
        for number in order:
            bucket = buckets[number]
            if len(bucket) > 1:
                shift = 0
                while True:
                    places = [cls.place(code, shift, size) for code, _ in bucket]
                    if len(set(places)) == len(places) and all(slots[p] is None for p in places):
                        break
                    shift += 1
                displacements[number] = shift
                for place, (_, key) in zip(places, bucket, strict=True):
                    slots[place] = key
            elif bucket:
                if free is None:
                    free = (i for i, key in enumerate(slots) if key is None)
                place = next(free)
                displacements[number] = -place - 1
                slots[place] = bucket[0][1]
        return cls(slots, [entries[key] for key in slots], displacements)

    @staticmethod
    def place(code: int, shift: int, size: int) -> int:
        return ((code >> 24 & 0xFFFFFFFF) + shift * (code >> 64 & 0xFFFFFFFF | 1) + shift * shift) % size

    def get(self, key: bytes) -> int | None:
        if not self.keys:
            return None
        code = xxhash.xxh3_128_intdigest(key)
        shift = self.displacements[code % len(self.displacements)]
        slot = -shift - 1 if shift < 0 else self.place(code, shift, len(self.keys))
        return self.values[slot] if self.keys[slot] == key else None


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token that is not one token: merge the pair of lowest rank, leftmost first, until none is left."""
    size = len(piece)
    # end[i]: end of the symbol that starts at i, 0 once it is merged away; before[i]: start of the symbol in front.
    end = list(range(1, size + 1))
    before = list(range(-1, size))
    rank_of = ranks.get
    heap = [
        (rank, i, i + 1, i + 2) for i in range(size - 1) if (rank := rank_of(piece[i : i + 2])) is not None
    ]
    heapify(heap)
    while heap:
        _, left, middle, right = heappop(heap)
        if end[left] != middle or end[middle] != right:
            continue
        end[left], end[middle] = right, 0
        if right < size:
            before[right] = left
            after = end[right]
            if (rank := rank_of(piece[left:after])) is not None:
                heappush(heap, (rank, left, right, after))
        front = before[left]
        if front >= 0 and (rank := rank_of(piece[front:right])) is not None:
            heappush(heap, (rank, front, left, right))
    ids, at = [], 0
    while at < size:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


@dataclass
class PairTable:
    """The pairs of tokens that make a token, sorted, with its rank: merges of many pre-tokens at once look them up."""

    keys: np.ndarray
    values: np.ndarray
    single: np.ndarray

    @classmethod
    def build(cls, ranks: dict[bytes, int]) -> PairTable | None:
        """None if a byte is no token: then not every pre-token can be encoded."""
        single = [ranks.get(bytes([value])) for value in range(256)]
        if None in single:
            return None
        made = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    made[left << 32 | right] = rank
        keys = np.fromiter(made, np.int64, len(made))
        order = np.argsort(keys)
        # One entry beyond all keys, so that a search always ends at one.
        values = np.fromiter(made.values(), np.int64, len(made))[order]
        return cls(np.append(keys[order], NO_RANK), np.append(values, NO_RANK), np.array(single, np.int64))

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NO_RANK`` where it makes no token or one side is -1 (no symbol)."""
        wanted = left << 32 | right
        at = np.searchsorted(self.keys, wanted)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), self.values[at], NO_RANK)


def merge_columns(pieces: list[bytes], table: PairTable) -> list[bytes]:
    """Packed ids of pre-tokens that are not one token, as ``merge_bytes`` gives them, all merged side by side.

    Each step merges in every piece its pair of lowest rank, the leftmost among equals, over a linked list of bytes in
    the piece's row; rows without a pair are done.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    width = int(sizes.max())
    held = np.arange(width) < sizes[:, None]
    # The last column, beyond every piece, stands for the end and, as number -1, for what is in front of the first byte.
    symbols = np.full((len(pieces), width + 1), -1, np.int64)
    symbols[:, :width][held] = table.single[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.tile(np.arange(1, width + 2), (len(pieces), 1))
    before = np.tile(np.arange(-1, width), (len(pieces), 1))
    ranks = np.full(symbols.shape, NO_RANK)
    ranks[:, :width] = table.ranks_of(symbols[:, :-1], symbols[:, 1:])
    rows = np.arange(len(pieces))
    while True:
        left = ranks[rows].argmin(1)
        made = ranks[rows, left]
        going = made != NO_RANK
        rows, left, made = rows[going], left[going], made[going]
        if not len(rows):
            break
        middle = after[rows, left]
        right = after[rows, middle]
        front = before[rows, left]
        symbols[rows, left] = made
        symbols[rows, middle] = -1
        after[rows, left] = right
        before[rows, right] = left
        ranks[rows, middle] = NO_RANK
        ranks[rows, left] = table.ranks_of(made, symbols[rows, right])
        ranks[rows, front] = table.ranks_of(symbols[rows, front], made)
    kept = symbols >= 0
    packed = symbols[kept].astype("<u4").tobytes()
    ends = (4 * np.cumsum(kept.sum(1))).tolist()
    return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@dataclass
class ByteBpe:
    """A vocabulary with its lookups; made on the driver and broadcast (its size is that of the vocabulary)."""

    ranks: dict[bytes, int]
    pattern: str
    whole: PerfectHash = field(init=False)
    pairs: PairTable | None = field(init=False)

    def __post_init__(self) -> None:
        self.whole = PerfectHash.build(self.ranks)
        self.pairs = PairTable.build(self.ranks)

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        """From a rank file: one base64 token and its rank per line."""
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def __getstate__(self) -> dict:
        return {name: self.__dict__[name] for name in ("ranks", "pattern", "whole", "pairs")}

    @cached_property
    def memo(self) -> _Memo:
        return _Memo(self)

    @cached_property
    def general(self) -> regex.Pattern:
        return regex.compile(self.pattern)

    @cached_property
    def tokens(self) -> list[bytes | None]:
        table: list[bytes | None] = [None] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            table[rank] = token
        return table

    def pre_tokens(self, text: str) -> list[str]:
        if self.pattern == KNOWN_PATTERN and not NOT_PLAIN.search(text):
            return PLAIN_PATTERN.findall(text)
        return self.general.findall(text)

    def encode_piece(self, piece: bytes) -> list[int]:
        found = self.whole.get(piece)
        return [found] if found is not None else merge_bytes(piece, self.ranks)

    def encode_packed(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Packed ids of each text; null counts as empty."""
        part, chars = [], 0
        for text in texts:
            part.append(self.pre_tokens(text or ""))
            chars += len(text or "")
            if chars >= PART_CHARS:
                yield from self._encode_part(part)
                part, chars = [], 0
        yield from self._encode_part(part)

    def _encode_part(self, part: list[list[str]]) -> Iterator[bytes]:
        memo = self.memo
        memo.learn(set().union(*part))
        for tokens in part:
            yield b"".join(map(memo.__getitem__, tokens))

    def decode_packed(self, packed: bytes) -> bytes | None:
        """The bytes of the ids; None if an id is not in the vocabulary."""
        try:
            return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        except (IndexError, TypeError, ValueError):
            return None


class _Memo(dict):
    """Pre-token to packed ids, filled on demand.

    Half as many entries as allowed are filled, then become the older half; what is asked for again moves back, so
    that frequent pre-tokens stay. The limit also holds within one text.
    """

    def __init__(self, bpe: ByteBpe) -> None:
        super().__init__()
        self.bpe = bpe
        self.older: dict[str, bytes] = {}

    def keep(self, token: str, packed: bytes) -> None:
        if len(self) >= MEMO_ENTRIES // 2:
            self.older = dict(self)
            self.clear()
        self[token] = packed

    def learn(self, tokens: set[str]) -> None:
        """Take up the pre-tokens that are not known yet: those of one token, and the short ones merged side by side."""
        bpe, rest = self.bpe, []
        for token in tokens.difference(self, self.older):
            piece = token.encode()
            found = bpe.whole.get(piece)
            if found is not None:
                self.keep(token, found.to_bytes(4, "little"))
            elif len(piece) <= COLUMNS and bpe.pairs:
                rest.append(piece)
        # Pieces of about one length fill the rows of a table.
        rest.sort(key=len)
        for at in range(0, len(rest), ROWS):
            run = rest[at : at + ROWS]
            for piece, packed in zip(run, merge_columns(run, bpe.pairs), strict=True):
                self.keep(piece.decode(), packed)

    def __missing__(self, token: str) -> bytes:
        packed = self.older.get(token)
        if packed is None:
            packed = np.array(self.bpe.encode_piece(token.encode()), "<u4").tobytes()
        if len(token) <= MEMO_CHARS:
            self.keep(token, packed)
        return packed


def encode(
    df: DataFrame,
    bpe: ByteBpe,
    text_col: str = "text",
    ids_col: str = "ids",
    keep: list[str] | None = None,
    decoded_col: str | None = None,
) -> DataFrame:
    """``keep`` (all columns by default, but those named like the new ones) and the packed ids of each whole text.

    With ``decoded_col`` the ids are also decoded by the same worker, for a round trip in one pass.
    """
    shared = df.sparkSession.sparkContext.broadcast(bpe)

    def work():
        own = shared.value

        def compute(texts: pa.Array) -> list[pa.Array]:
            packed = list(own.encode_all(texts.to_pylist()))
            made = [pa.array(packed, pa.binary())]
            if decoded_col:
                made.append(pa.array(map(own.decode_packed, packed), pa.binary()))
            return made

        return compute

    new = [ids_col, decoded_col] if decoded_col else [ids_col]
    keep = [name for name in (df.columns if keep is None else keep) if name not in new]
    return map_arrow(df, [text_col], keep, [T.StructField(name, T.BinaryType()) for name in new], work)


def decode(
    df: DataFrame, bpe: ByteBpe, ids_col: str = "ids", bytes_col: str = "decoded", keep: list[str] | None = None
) -> DataFrame:
    """``keep`` (all columns by default, but one named ``bytes_col``) and the bytes of the packed ids.

    Null ids, and ids outside the vocabulary, decode to null.
    """
    shared = df.sparkSession.sparkContext.broadcast(bpe)

    def work():
        own = shared.value

        def compute(packed: pa.Array) -> list[pa.Array]:
            decoded = [None if ids is None else own.decode_packed(ids) for ids in packed.to_pylist()]
            return [pa.array(decoded, pa.binary())]

        return compute

    keep = [name for name in (df.columns if keep is None else keep) if name != bytes_col]
    return map_arrow(df, [ids_col], keep, [T.StructField(bytes_col, T.BinaryType())], work)

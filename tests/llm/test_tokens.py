"""BPE against the public library, and training-order shards against what was written."""

import base64
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerbline.llm import bpe, queries, shards

TEXTS = ["", None, "Hello world's  end\n\n  x", "ñandú ½ ² Ⅷ 中文   🙂🙂", "a" * 5000, "  \t\r\n ", "it's 12345 !!??\x1c\x1d x", "word " * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.ByteBpe.load(queries.VOCABULARY, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(queries.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_perfect_hash_is_minimal_and_exact(tokenizer):
    table = tokenizer.whole
    assert sorted(table.keys) == sorted(tokenizer.ranks)
    assert all(table.get(token) == rank for token, rank in tokenizer.ranks.items())
    assert all(table.get(token + b"\xff\x00") is None for token in list(tokenizer.ranks)[:2000])
    assert bpe.PerfectHash.build({}).get(b"a") is None


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(tokenizer, library, text):
    packed = tokenizer.encode_packed(text)
    assert ids(packed) == library.encode_ordinary(text)
    assert tokenizer.decode_packed(packed) == text.encode()


def test_both_pattern_engines_agree(tokenizer):
    for text in TEXTS:
        text = text or ""
        if not bpe.NOT_PLAIN.search(text):
            assert bpe.PLAIN_PATTERN.findall(text) == tokenizer.general.findall(text)


def test_every_plain_character_is_classed_alike(tokenizer):
    for code in range(0x250, 0x2B0):
        assert bpe.PLAIN_PATTERN.findall(f"a{chr(code)}1") == tokenizer.general.findall(f"a{chr(code)}1")
    for code in [*range(0x250), *range(0x2010, 0x2028)]:
        text = f"a{chr(code)}b {chr(code)}1"
        if not bpe.NOT_PLAIN.search(text):
            assert bpe.PLAIN_PATTERN.findall(text) == tokenizer.general.findall(text), hex(code)


def test_encode_and_decode_tables(spark, tokenizer, library):
    rows = [(i, text, "clash", "clash") for i, text in enumerate(TEXTS)] + [(0, TEXTS[0], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    encoded = bpe.encode(docs, tokenizer)
    assert encoded.columns == ["doc_id", "text", "decoded", "ids"]
    done = bpe.decode(encoded, tokenizer).collect()
    assert len(done) == len(rows)
    for row in done:
        assert ids(row.ids) == library.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()
    assert bpe.encode(docs.limit(0), tokenizer).count() == 0
    at_once = bpe.encode(docs, tokenizer, keep=["doc_id", "ids"], decoded_col="decoded")
    assert at_once.columns == ["doc_id", "ids", "decoded"]
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in at_once.collect()) == sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in done)


def test_ids_outside_the_vocabulary_decode_to_null(spark, tokenizer):
    rows = [(1, bytearray(struct.pack("<I", 60_000))), (2, None), (3, bytearray(b"abc")), (4, bytearray(b""))]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids binary"), tokenizer).collect()
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in got} == {1: None, 2: None, 3: None, 4: bytearray(b"")}


def test_a_full_memo_starts_afresh(tokenizer, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    for text in ("one two three four five", "six seven eight", "one nine"):
        assert ids(tokenizer.encode_packed(text)) == library.encode_ordinary(text)


@pytest.mark.parametrize("count", [0, 1, 2, 3, 17, 1000, 4097])
def test_slots_are_a_permutation(count):
    slots = shards.slots_of(np.arange(count), count, "k")
    assert sorted(slots.tolist()) == list(range(count))
    if count > 100:
        assert slots.tolist() != shards.slots_of(np.arange(count), count, "other").tolist()
        assert (slots[:-1] < slots[1:]).mean() < 0.6


def write(spark, tmp_path, layout, rows):
    source = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3).write.parquet(source)
    path = str(tmp_path / "shards")
    total = shards.write_shards(shards.byte_ids(spark.read.parquet(source)), path, "k", layout)
    return path, total


def test_shards_hold_every_sequence_at_its_slot(spark, tmp_path):
    layout = shards.Layout(length=16, shard_rows=8)
    rows = [(i, f"text {i} " * (i % 7) + "\n\0é", "x") for i in range(40)] + [(40, None, None), (None, "", None), (3, "again", None)]
    path, total = write(spark, tmp_path, layout, rows)
    got = shards.read_shards(spark, path, layout).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(total))
    assert all(layout.place(r.slot) == (r.shard, r.byte_offset) for r in got)
    texts = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.part)):
        if r.doc_id != 3:
            texts[r.doc_id] = texts.get(r.doc_id, b"") + bytes(r.ids)
    expected = {-1 if i is None else i: (text or "").encode() for i, text, _ in rows if i != 3}
    assert texts == expected
    for r in got[:5]:
        (file,) = (tmp_path / "shards" / f"shard={r.shard}").glob("*.txt")
        assert struct.unpack_from(shards.HEADER, file.read_bytes(), r.byte_offset) == (r.doc_id, r.part, r.n_tokens)
        assert file.stat().st_size % layout.stride == 0
    later = shards.read_shards(spark, path, layout, first_slot=11).orderBy("slot").collect()
    assert later == got[11:]


def test_wider_ids_and_empty_input(spark, tmp_path):
    layout = shards.Layout(length=4, width=2, shard_rows=2)
    source = str(tmp_path / "ids")
    packed = np.arange(10, dtype="<u2").tobytes()
    spark.createDataFrame([(5, bytearray(packed))], "id long, ids binary").write.parquet(source)
    assert shards.write_shards(spark.read.parquet(source), str(tmp_path / "out"), "k", layout) == 3
    got = shards.read_shards(spark, str(tmp_path / "out"), layout).orderBy("part").collect()
    assert b"".join(bytes(r.ids) for r in got) == packed and [r.n_tokens for r in got] == [4, 4, 2]
    none = spark.read.parquet(source).where(F.lit(False))
    assert shards.write_shards(none, str(tmp_path / "none"), "k", layout) == 0


def test_pieces_merged_side_by_side_as_one_by_one(tokenizer, library):
    rng = np.random.default_rng(2)
    pieces = [bytes(rng.choice(list(" aeinrstüñß中".encode()), rng.integers(1, 33)).tolist()) for _ in range(3000)]
    pieces += [b"a" * 32, b" the", b"\xff"]
    made = bpe.merge_columns(pieces, tokenizer.pairs)
    assert [ids(packed) for packed in made] == [bpe.merge_bytes(piece, tokenizer.ranks) for piece in pieces]
    assert bpe.PairTable.build({b"a": 0, b"aa": 1}) is None


def test_memory_for_seen_pieces_is_bounded_within_one_text(tokenizer, library, monkeypatch):
    """Frequent pieces among rare ones, a text of many parts, and pieces too long to be remembered."""
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 200)
    monkeypatch.setattr(bpe, "PART_CHARS", 1000)
    own = bpe.ByteBpe(tokenizer.ranks, tokenizer.pattern)
    text = " ".join(f"the xq{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}zv{chr(97 + i // 676)}" for i in range(5000))
    texts = [text, None, "", "x" * 5000, *TEXTS, text]
    assert [ids(packed) for packed in own.encode_all(texts)] == [library.encode_ordinary(t or "") for t in texts]
    assert len(own.memo) <= 200
    assert max(map(len, own.memo)) <= bpe.MEMO_CHARS

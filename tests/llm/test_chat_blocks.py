"""Blocks of conversations whose turn numbers repeat or are null."""

import random

from pyspark.sql import functions as F

from kerbline.llm import transcripts

CHAT = "conv_id long, turn long, text string, role string"


def test_blocks_are_bounded_whatever_the_turn_numbers_are(spark, monkeypatch):
    rng = random.Random(3)
    lines = ["User: what is it?", "a plain line", "- listed", "Assistant: so", "is it?", "x" * 50, "System: be brief"]
    turns = [(1, 0), (1, 1), (1, None), (1, 5000), (None, 3), (None, None), (2, 0)]
    rows = []
    for conv, turn in turns:
        rows += [(conv, turn, rng.choice(lines) + rng.choice(["", "", f"\n{rng.randrange(9)}"]), "user") for _ in range(23)]
    rows += [(1, 0, "the same row", "assistant")] * 30 + [(3, t, f"text {t}", "user") for t in range(4)]
    chats = spark.createDataFrame(rows, CHAT).repartition(5)
    model = transcripts.fit(spark.createDataFrame([(c, t, x, random.Random(i).choice(transcripts.ROLES)) for i, (c, t, x, _) in enumerate(rows)], CHAT))
    whole = sorted(map(repr, transcripts.format_chats(chats, model).collect()))
    monkeypatch.setattr(transcripts, "BLOCK_ROWS", 8)
    sizes = []
    in_blocks = transcripts.in_blocks

    def spied(held):
        sizes.append(held.groupBy("conv", "block", "sub").count().agg(F.max("count")).first()[0])
        return in_blocks(held)

    monkeypatch.setattr(transcripts, "in_blocks", spied)
    got = sorted(map(repr, transcripts.format_chats(chats, model).collect()))
    assert got == whole and len(got) >= len(rows)
    assert len(sizes) == 2 and max(sizes) <= 8

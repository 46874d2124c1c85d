import random

import pytest

from kerbline.operators import retrieval

DOCS = [
    "When congestion > 70%, agent should hold_phase.",
    "Police pursuit: lock all crossing phases to red.",
    "Below the bridge two CARS wait",
    None,
    "",
    "carcar low low",
]


def brute(query, docs, k):
    words = set(query.lower().split())
    scored = [(sum(w in (text or "").lower() for w in words), i) for i, text in enumerate(docs)]
    return sorted(((s, i) for s, i in scored if s), key=lambda p: (-p[0], p[1]))[:k]


def run(spark, queries, docs, k, **kwargs):
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    table = spark.createDataFrame(list(enumerate(docs)), "doc_ord int, text string")
    found = retrieval.retrieve(asked, table, k, **kwargs).collect()
    got = {q: [] for q in queries}
    for r in sorted(found, key=lambda r: r["rank"]):
        got[r.query].append((r.score, r.doc_ord))
        assert r.text == docs[r.doc_ord]
    return got


QUERIES = ["low congestion car", "Police  high\tRED", "nothing matches xyzzy", "", "low low car", "a"]


@pytest.mark.parametrize("k", [1, 2, 10])
def test_few_queries(spark, k):
    assert run(spark, QUERIES, DOCS, k) == {q: brute(q, DOCS, k) for q in QUERIES}


@pytest.mark.parametrize("k, per_token", [(1, 4096), (10, 0)])
def test_many_queries(spark, k, per_token, monkeypatch):
    monkeypatch.setattr(retrieval, "MAX_WORDS_PER_TOKEN", per_token)
    assert run(spark, QUERIES, DOCS, k, max_inline=1) == {q: brute(q, DOCS, k) for q in QUERIES}


def test_many_queries_and_large_tables(spark, force_large):
    rng = random.Random(5)
    letters = "aábc"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    # one token in every document, as a stop word would be
    docs = [" ".join(["the", *[word() for _ in range(rng.randint(0, 30))]]) for _ in range(60)]
    docs.append("a" * 700 + "á" + "b" * 700 + " the")  # a token longer than several chunks
    queries = sorted({" ".join([word(), word(), rng.choice(["the", "he"])]) for _ in range(25)} | {"a" * 300 + " aaáb", "aáb"})
    assert run(spark, queries, docs, 3, max_inline=1) == {q: brute(q, docs, 3) for q in queries}


def test_contexts_cut_join_and_default(spark):
    asked = spark.createDataFrame([("low car",), ("xyzzy",), ("low car",)], "query string")
    docs = spark.createDataFrame([(0, "low " + "x" * 100), (1, "a car is slow"), (2, "car")], "doc_ord int, text string")
    got = {r.query: r.context for r in retrieval.contexts(asked, docs, 2, 10, "none").collect()}
    assert got == {"low car": "a car is s; low xxxxxx", "xyzzy": "none"}


def test_documents_are_shuffled_as_lists_of_numbers(spark, force_large, monkeypatch):
    """What is kept per document is one row, however many words it holds, and no query's text goes with it."""
    kept = {}

    def watched(df, name):
        kept[name] = made = stored(df, name)
        return made

    stored = retrieval.store
    monkeypatch.setattr(retrieval, "store", watched)
    docs = [" ".join(f"word{i % 7}{i}" for i in range(at, at + 40)) for at in range(30)]
    queries = [f"word{i % 7}{i} word wor" for i in range(20)]
    assert run(spark, queries, docs, 2, max_inline=1) == {q: brute(q, docs, 2) for q in queries}
    assert kept["doc-words"].count() == len(docs)
    assert kept["doc-words"].schema.simpleString() == "struct<doc_ord:int,words:array<bigint>>"
    assert dict(kept["rare-scores"].dtypes)["query"] == "bigint"

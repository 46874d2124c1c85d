"""b-bit MinHash near-duplicates against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import minhash, simhash
from kerbline.llm.common import stored

SCHEMA = "doc_id long, text string, n long, cls string, component_id string"
BY_THREE = minhash.Settings(words=3, similarity=(85, 100), bands=40, link_empty=False)
BY_FIVE = minhash.Settings()


def shingle_set(text, words):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def is_linked(a, b, settings):
    part, whole = settings.similarity
    if not a and not b:
        return settings.link_empty
    return whole * len(a & b) >= part * len(a | b)


def corpus():
    rng = random.Random(11)
    rows = []
    for size in (1, 2, 3, 5, 12, 40, 150, 600):
        base = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(size)]
        for changes in (0, 0, 1, 1, 2, 4, 8, 12):
            words = list(base)
            for _ in range(min(changes, size // 8)):
                words[rng.randrange(size)] = f"z{rng.randrange(1000)}"
            rows.append((" " if changes % 2 else "  ").join(words))
        rows.append(" ".join(base).upper())
    rows = [(i, text) for i, text in enumerate([*rows, None, "", " \n", "ÄÖ ÄÖ", "äö äö", "w" * 50_000, "é " * 30_000])]
    rows += [rows[3], rows[3], (None, rows[40][1]), (None, "only without an id"), (7, "another text of this id"), (3, rows[60][1])]
    return [(*row, 1, "c", "d") for row in rows]


def plain_components(rows, settings):
    """Component of each row of ``rows`` by all pairs, named by the smallest id."""
    sets = [shingle_set(row[1], settings.words) for row in rows]
    names = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if names[a] != names[b] and is_linked(sets[a], sets[b], settings):
            names = [names[a] if name == names[b] else name for name in names]
    least = {}
    for name, row in zip(names, rows, strict=True):
        if row[0] is not None:
            least[name] = min(row[0], least.get(name, row[0]))
    return [(least.get(name), len(s)) for name, s in zip(names, sets, strict=True)], names


@pytest.mark.parametrize("settings", [BY_THREE, BY_FIVE], ids=["three", "five"])
@pytest.mark.parametrize("block", [minhash.BLOCK, 2])
def test_components_equal_all_pairs(spark, settings, block):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    got = minhash.near_duplicates(docs, settings, block=block).collect()
    expected, _ = plain_components(corpus(), settings)
    wanted = [(row[0], size, component, row[0] == component) for row, (component, size) in zip(corpus(), expected, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))


@pytest.mark.parametrize("drop", [minhash.drop_near_duplicates, simhash.drop_near_duplicates])
def test_one_row_of_each_component_stays(spark, drop):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    kept = drop(docs, BY_FIVE)
    _, names = plain_components(corpus(), BY_FIVE)
    assert kept.columns == docs.columns
    rows = [tuple(row) for row in kept.collect()]
    assert len(rows) == len(set(names)) and set(rows) <= set(corpus())
    position = {}
    for at, row in enumerate(corpus()):
        position.setdefault(row, at)
    assert sorted(names[position[row]] for row in rows) == sorted(set(names))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0


def test_chains_within_a_large_group_lose_no_link(spark):
    """Near copies of one text of which only some are close enough to each other, in blocks of a few members."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 5, 9])):
            words[at] = f"x{rng.randrange(100_000)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, BY_THREE, block=8).collect()}
    expected, _ = plain_components(rows, BY_THREE)
    assert got == {i: component for i, (component, _) in enumerate(expected)}
    assert 1 < len(set(got.values())) < 60


@pytest.mark.parametrize("size", [200, 400])
def test_a_passage_of_many_texts_makes_few_candidates(spark, size):
    """Texts that share 60 of 150 words are no candidates; what is looked at grows with the number of texts."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"w{rng.randrange(10**9)}" for _ in range(90)] + passage)) for i in range(size)]
    docs = spark.createDataFrame([(i, text, i) for i, text in rows], "id long, text string, row long")
    signed = stored(minhash.signatures(docs, BY_FIVE), "test-signatures")
    entries = signed.select("id", F.posexplode("packed").alias("band", "word")).groupBy("band", "word").count()
    met = entries.where("count > 1").agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0))).first()[0]
    assert met <= 3 * size


def test_estimate_is_close_and_recall_is_whole():
    """Pairs at the threshold: all meet in a band, and the corrected estimate stays within its margin."""
    rng = np.random.default_rng(1)
    flips, factors = minhash.draws(BY_FIVE.bands)
    missed, errors = 0, []
    for _ in range(1_000):
        both = rng.integers(0, 1 << 63, 80, np.uint64)
        own = rng.integers(0, 1 << 63, 20, np.uint64)
        a, b = (minhash.signature(np.unique(s), flips, factors) for s in (np.concatenate([both, own[:10]]), np.concatenate([both, own[10:]])))
        missed += not (a == b).any()
        share = (a.view(np.uint8) == b.view(np.uint8)).mean()
        errors.append((share - 1 / 256) / (1 - 1 / 256) - 0.8)
    assert missed == 0
    assert min(errors) > BY_FIVE.floor - 0.8 and abs(np.mean(errors)) < 0.005


def test_bit_counts_equal_a_plain_count(spark):
    rng = np.random.default_rng(2)
    a, b = (rng.integers(-(1 << 63), 1 << 63, 40, np.int64) for _ in range(2))
    b[::3] = a[::3]
    a8, b8 = a.view(np.uint8), b.view(np.uint8)
    row = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<long>, b array<long>")
    share = (a8 == b8).mean()
    got = row.select(minhash.estimate(F.col("a"), F.col("b"), 40)).first()[0]
    assert got == pytest.approx((share - 1 / 256) / (1 - 1 / 256))

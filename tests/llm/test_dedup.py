"""Exact and near de-duplication against plain versions."""

import hashlib
import random
import re
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from kerbline.llm import components, exact_dedup, simhash
from kerbline.session import store

SCHEMA = "doc_id long, text string, keep_id string, component_id string, fp string"


def passage(rng, words):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(words))


def corpus():
    """Copies, near copies, odd white space, nulls, empty texts, repeated rows, a long text."""
    rng = random.Random(5)
    base = [passage(rng, n) for n in (1, 2, 3, 40, 200, 3000)]
    texts = [*base, *base, base[3].replace(" ", " \t\n"), f" {base[3]} ", base[3].upper(), None, "", " ", " ", None]
    for text in base[3:]:
        words = text.split()
        for _ in range(4):
            changed = list(words)
            changed[rng.randrange(len(changed))] = "zz"
            texts.append(" ".join(changed))
    rows = [(i, text, "a", "b", "c") for i, text in enumerate(texts)]
    return [*rows, rows[0], (None, base[2], None, None, None), (None, "only without an id", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain_exact(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(normal(text), []).append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        ids = groups[normal(text)]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256(normal(text).encode()).hexdigest()))
    return out


def as_set(rows):
    return sorted(map(repr, map(tuple, rows)))


def few_hashes(chunk):
    return F.pmod(F.length(chunk), F.lit(3)).cast("long")


@pytest.mark.parametrize("chunk_hash", [F.xxhash64, few_hashes], ids=["xxhash", "clashing"])
def test_exact_equals_plain_grouping(docs, chunk_hash):
    got = exact_dedup.exact_duplicates(docs, chunk_hash=chunk_hash).collect()
    assert as_set(got) == as_set(plain_exact(corpus()))


def test_chunks_join_to_the_normalised_text_and_are_bounded(docs):
    for row in exact_dedup.cut(docs, "doc_id", "text").join(docs.select("doc_id", "text").distinct().toDF("id", "text"), "id").collect():
        assert " ".join(row.chunks) == normal(row.text)
        assert all(len(chunk.split(" ")) <= exact_dedup.MAX_WORDS for chunk in row.chunks)


def test_chunks_are_defined_by_content(spark):
    rng = random.Random(9)
    text = passage(rng, 2000)
    rows = spark.createDataFrame([(1, text), (2, passage(rng, 7) + " " + text)], "doc_id long, text string")
    first, second = (set(row.chunks) for row in exact_dedup.cut(rows, "doc_id", "text").orderBy("id").collect())
    assert len(first & second) >= len(first) - 1 > 5


def test_whole_query_is_native(docs, monkeypatch):
    """Every plan that the query stores on its way and the one it returns, with and without clashing hashes."""
    plans = []

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(exact_dedup, "stored", watched)
    for chunk_hash in (F.xxhash64, few_hashes):
        rows = exact_dedup.exact_duplicates(docs, chunk_hash=chunk_hash)
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
    assert len(plans) >= 8
    # The made-up input is a Python table itself; only its scan may say so.
    assert not any(re.search("Python|Arrow|Pandas", line) for plan in plans for line in plan.splitlines() if "ExistingRDD" not in line)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(nodes, links):
    label = {node: node for node in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def plain_near(rows):
    prints = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            prints[doc_id] = plain_fingerprint(text)
    links = [(a, b) for a, b in combinations(prints, 2) if bin(prints[a] ^ prints[b]).count("1") <= 3]
    return {i: (f"{prints[i]:016x}", c) for i, c in plain_components(prints, links).items()}


@pytest.mark.parametrize("list_entries", [256, 1])
def test_near_equals_plain_version(docs, list_entries):
    got = simhash.near_duplicates(docs, list_entries=list_entries)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    rows = got.collect()
    assert len(rows) == len(corpus())
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows if r.doc_id is not None} == plain_near(corpus())


@pytest.mark.parametrize("list_entries", [64, 3])
def test_links_between_close_fingerprints_are_all_found(spark, list_entries):
    rng = random.Random(3)
    prints = []
    for _ in range(12):
        print_ = rng.getrandbits(64)
        for _ in range(15):
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                print_ ^= 1 << bit
            prints.append(print_)
    prints = sorted(set(prints))
    classes = spark.createDataFrame([(p - (p >> 63 << 64), i) for i, p in enumerate(prints)], "fp long, rep long")
    close = [(a, b) for a, b in combinations(range(len(prints)), 2) if bin(prints[a] ^ prints[b]).count("1") <= 3]
    expected = plain_components(range(len(prints)), close)
    linked = {r.node: r.component for r in components.components(simhash.links(classes, list_entries)).collect()}
    assert {i: linked.get(i, i) for i in range(len(prints))} == expected


def test_positions_cover_every_five_bytes():
    sets = [set(p) for p in simhash.POSITIONS]
    assert all(any(s <= set(five) for s in sets) for five in combinations(range(8), 5))


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    rng = random.Random(1)
    names = rng.sample(range(1000), 200)
    links = [(names[a], names[b]) for a, b in links]
    nodes = {node for a, b in links for node in (a, b)}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == plain_components(nodes, links)


def test_dropping_keeps_columns_and_the_smallest_id(docs):
    exact = exact_dedup.drop_exact_duplicates(docs.where("doc_id is not null").distinct())
    assert exact.columns == docs.columns
    assert {r.doc_id for r in exact.collect()} == {r[0] for r in plain_exact(corpus()) if r[0] is not None and r[3]}
    near = simhash.drop_near_duplicates(docs.where("doc_id is not null").distinct())
    assert near.columns == docs.columns
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in plain_near(corpus()).items() if i == c}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert exact_dedup.drop_exact_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(none).count() == 0

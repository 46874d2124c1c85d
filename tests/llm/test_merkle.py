"""The Merkle manifest against a plain tree."""

import hashlib

import pytest
from pyspark.sql import functions as F

from kerbline.llm import merkle

SCHEMA = "doc_id long, lang string, text string, tree string, part string, id string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row):
    return sha("".join(encoded(row[i]) for i in (0, 1, 2)))


def corpus():
    rows = [(i * 7 % 101, "en", f"text {i}") for i in range(101)]
    rows += [(200 + i, "de", None if i % 3 else "") for i in range(9)]
    rows += [(300, "fr", "alone"), (None, "fr", "no id"), (301, None, "no group"), (5, "en", "another row of this id")]
    rows += [rows[3], rows[3], (302, "", "empty group"), (303, "é", "long " * 40_000)]
    return [(*row, "t", "p", "i") for row in rows]


def plain_tree(hashes):
    """The root, and per leaf the sibling texts and places."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    proofs = []
    for at in range(len(hashes)):
        proof, places = [], []
        for nodes in levels[:-1]:
            run = at // 8 * 8
            proof.append("".join(n for i, n in enumerate(nodes[run : run + 8], run) if i != at))
            places.append(at % 8)
            at //= 8
        proofs.append((proof, places))
    return levels[-1][0], proofs


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_tree([entry[2] for entry in sorted(groups[name], key=lambda e: e[:3])]) for name in names]
    root, above = plain_tree([tree[0] for tree in trees])
    out = []
    for name, (subroot, proofs), (more, more_places) in zip(names, trees, above, strict=True):
        for entry, (proof, places) in zip(sorted(groups[name], key=lambda e: e[:3]), proofs, strict=True):
            out.append((entry[3], name, entry[2], proof + more, places + more_places, subroot, root))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def leaves(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(5)
    leaf = merkle.leaf_hash(F.col("doc_id"), F.col("lang"), F.col("text"))
    return docs.select("doc_id", "lang", leaf.alias("leaf"))


@pytest.mark.parametrize("levels", [merkle.LEVELS, 1])
def test_proofs_equal_those_of_a_plain_tree(leaves, levels):
    proven = merkle.prove(merkle.build(leaves, levels=levels)).collect()
    got = [(r["id"], r["group"], r.leaf, r.proof, r.places, r.subroot, r.root) for r in proven]
    assert sorted(got, key=repr) == plain(corpus())


def test_some_leaves_are_proven_by_themselves(leaves):
    manifest = merkle.build(leaves, levels=2)
    some = merkle.prove(manifest, manifest.leaves.where("id in (5, 6, 77, 300)"))
    root = merkle.fold_proof(F.col("leaf"), F.col("proof"), F.col("places"))
    rows = some.select("id", (root == F.col("root")).alias("verified")).collect()
    assert sorted(r["id"] for r in rows) == [5, 5, 6, 77, 300] and all(r.verified for r in rows)
    changed = merkle.fold_proof(F.sha2("leaf", 256), F.col("proof"), F.col("places"))
    assert not some.where(changed == F.col("root")).count()


def test_coordinates_are_the_least_union():
    assert merkle.missing(range(64), 64) == []
    assert merkle.missing(range(8), 64) == [(1, i) for i in range(1, 8)]
    assert merkle.missing([0, 9], 20) == [(0, i) for i in (*range(1, 8), 8, *range(10, 16))] + [(1, 2)]
    assert merkle.missing([0], 1) == []


def test_empty_table_and_one_row(spark, leaves):
    empty = merkle.build(leaves.limit(0))
    assert empty.root is None and merkle.prove(empty).count() == 0
    one = spark.createDataFrame([(1, "en", "ab")], "doc_id long, lang string, leaf string")
    row = merkle.prove(merkle.build(one)).first()
    assert (row.subroot, row.root, row.proof, row.places) == ("ab", "ab", [], [])

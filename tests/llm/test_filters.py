"""Toxicity, URL filter and decontamination against plain versions and held-out rows."""

import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from kerbline.llm import decontaminate, queries, toxicity, url_filter

SF = "/root/testdata/sf0.01"


def rows_of(df, key):
    return sorted(map(repr, map(tuple, df.select(sorted(df.columns)).collect())))


def sql_rows(sql, sf_dir, tables):
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    frame = con.execute(sql)
    names = [d[0] for d in frame.description]
    order = [names.index(name) for name in sorted(names)]
    return sorted(repr(tuple(row[i] for i in order)) for row in frame.fetchall())


# ---- URL filter ---------------------------------------------------------------------------------


def test_url_query_equals_sql(spark):
    got = rows_of(queries.op4_url_filter(spark, SF), "page_id")
    assert got == sql_rows(queries.ORACLES["op4_url_filter"], SF, ["pages", "labels"])


def test_exact_query_equals_sql(spark):
    got = rows_of(queries.op7_exact_dedup(spark, SF), "doc_id")
    assert got == sql_rows(queries.ORACLES["op7_exact_dedup"], SF, ["documents"])


URLS = [
    (1, "HTTP://WWW.Example.COM/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    (2, "https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    (3, "https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    (4, "https://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    (5, "https://x.com", "x.com", "", None, None),
    (6, "no scheme", "", "", None, None),
    (7, None, "", "", None, None),
    (8, "a://b?u=c://d/e", "b", "", None, None),
    (9, "", "", "", None, None),
    (2, "https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    (10, "x://É.COM/a\nb?c", "É.com", "/a\nb", "com/", "allow"),
]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([row[:2] for row in URLS], "page_id long, url string")
    pages = pages.withColumn("host", F.lit(1)).withColumn("verdict", F.lit("clash"))
    outcomes = spark.createDataFrame([], "host string, bad int")
    got = url_filter.judge(pages, outcomes, queries.URL_RULES).collect()
    expected = [(i, host, path, rule, verdict or "allow") for i, _, host, path, rule, verdict in URLS]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert url_filter.judge(pages.limit(0), outcomes, queries.URL_RULES).count() == 0


def test_reputation_shrinks_and_blocks_only_with_evidence(spark):
    outcomes = [("bad.spam.org", 1)] * 60 + [("once.fine.com", 1)] + [("a.fine.com", 0)] * 200 + [("b.spam.org", 1)] * 20 + [("c.ok.net", 0)] * 50
    outcomes += [("c.ok.net", None)]
    hosts = spark.createDataFrame([(h,) for h in ("bad.spam.org", "once.fine.com", "a.fine.com", "new.spam.org", "new.fine.com", "q.zz", "")], "host string")
    rows = url_filter.reputations(hosts, spark.createDataFrame(outcomes, "host string, bad int"))
    got = {r.host: (r.alpha / (r.alpha + r.beta), r.blocked) for r in rows.withColumn("blocked", url_filter.blocked(F.col("alpha"), F.col("beta"))).collect()}
    assert got["bad.spam.org"][1] and not got["once.fine.com"][1] and not got["a.fine.com"][1]
    assert got["once.fine.com"][0] < 1
    assert got["new.spam.org"][0] > got["q.zz"][0] > got["new.fine.com"][0]


def test_domains_and_suffixes(spark):
    rows = spark.createDataFrame([("a.b.co.uk",), ("a.b.com",), ("com",), ("1.2.3.4",), ("",)], "h string")
    got = rows.select("h", url_filter.domain_of(F.col("h")), url_filter.suffix_of(F.col("h"))).collect()
    assert {tuple(r) for r in got} == {("a.b.co.uk", "b.co.uk", "co.uk"), ("a.b.com", "b.com", "com"), ("com", "com", "com"), ("1.2.3.4", "1.2.3.4", "1.2.3.4"), ("", "", "")}


# ---- decontamination ----------------------------------------------------------------------------


def distance_to_passage(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        diagonal, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (p != t))
    return min(row)


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = "z"
        elif kind == 1:
            chars.insert(at, "q")
        elif len(chars) > 1:
            del chars[at]
    return "".join(chars)


def leak_rows():
    rng = random.Random(11)

    def words(n):
        return " ".join("".join(rng.choices("abcde", k=rng.randint(2, 5))) for _ in range(n))

    items = [(i, words(rng.randint(8, 20))) for i in range(12)] + [(50, None), (51, ""), (52, "Too Short?"), (None, words(9)), (None, "2+2? Four")]
    items += [(60, items[0][1]), (0, items[0][1])]
    docs = []
    for i, text in items[:12]:
        for edits in (0, 1, 3, 6, 9, 14):
            docs.append(f"{words(10)} {edited(rng, text, edits)}\n {words(10)}")
        docs.append(text[: len(text) // 2] + words(20))
        docs.append(text.upper().replace(" ", "\n\t "))
    docs += [None, "", " ", words(3000), docs[0], items[15][1] + " end", "What is 2+2? Four", "22+2? four", "so 2+2? \nfour.", "it is far too  short? Yes"]
    return items, list(enumerate(docs))


def plain_leaks(items, text):
    """Item and distance of each test item in a text: within a tenth of its characters, short ones as whole words."""
    found, text = [], " ".join((text or "").lower().split())
    for item_id, item in dict.fromkeys((i, " ".join((t or "").lower().split())) for i, t in items):
        if item and len(item) < 20:
            if re.search(rf"(?<![^\W_]){re.escape(item)}(?![^\W_])", text):
                found.append((item_id, 0))
        elif item and (distance := distance_to_passage(item, text)) <= len(item) // 10:
            found.append((item_id, distance))
    return found


@pytest.mark.parametrize("block_chars, at_once, ids", [(500_000, 8, "long"), (200, 2, "string")])
def test_leaks_equal_plain_search(spark, monkeypatch, block_chars, at_once, ids):
    monkeypatch.setattr(decontaminate, "BLOCKS_AT_ONCE", at_once)
    items, docs = leak_rows()
    items_df = spark.createDataFrame(items, "item_id long, text string").withColumn("item_id", F.col("item_id").cast(ids))
    docs_df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, leaks string").repartition(3)
    got = decontaminate.mark_leaks(docs_df, items_df, block_chars=block_chars)
    assert got.columns == ["doc_id", "text", "leaks"]
    found = {r.doc_id: r.leaks for r in got.collect()}
    near = 0
    for doc_id, text in docs:
        expected = plain_leaks([(i if i is None or ids == "long" else str(i), t) for i, t in items], text)
        assert sorted(map(str, (leak.item_id for leak in found[doc_id]))) == sorted(str(i) for i, _ in expected)
        least = dict(expected)
        for leak in found[doc_id]:
            if leak.item_id is not None:
                near += leak.distance > 0
                assert leak.distance >= least[leak.item_id]
                item = " ".join(dict((str(i), t) for i, t in items)[str(leak.item_id)].lower().split())
                passage = " ".join((text or "").lower().split())[leak.start : leak.end]
                assert distance_to_passage(item, passage) == leak.distance
    assert near > 20
    kept = decontaminate.drop_leaks(docs_df, items_df)
    assert kept.columns == docs_df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in found if not found[i]}


def test_no_items_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [r.leaks for r in decontaminate.mark_leaks(docs, items).collect()] == [[]]
    assert decontaminate.drop_leaks(docs.limit(0), items).count() == 0


def test_planted_benchmark_passages_are_found(spark):
    got = {r.doc_id: set(r.item_ids) for r in queries.op5_benchmark_decontamination(spark, SF).collect()}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    for row in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        text = decontaminate.normalised(row.text)
        for item in items:
            if decontaminate.normalised(item.text) in text:
                assert item.item_id in got[row.doc_id]


# ---- toxicity -----------------------------------------------------------------------------------


def labelled(rng, n):
    plain = "the a of to in river stone garden letter morning window paper quiet market".split()
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=12)
        toxic = int(rng.random() < 0.3)
        if toxic:
            words.insert(3, rng.choice(["idiotic", "scumbag", "worthlessly"]))
            if rng.random() < 0.9:
                words.insert(5, "women")
        elif rng.random() < 0.02:
            words.insert(5, "women")
        docs.append((i, " ".join(words), "clash"))
        labels.append((i, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def toxic_tables(spark):
    docs, labels = labelled(random.Random(2), 900)
    docs += [(2000, None, "x"), (2001, "", "x"), (None, "worthlessly scumbag", "x"), (0, docs[0][1], "x")]
    labels += [(0, labels[0][1]), (5000, 1), (None, 1), (7, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(toxic_tables):
    docs, labels = toxic_tables
    model = toxicity.fit(docs, labels)
    scored = toxicity.add_score(docs, model)
    assert scored.columns == ["doc_id", "text", "score"]
    held = scored.join(labels.distinct(), "doc_id").where("toxic is not null and crc32(cast(doc_id as string)) % 5 = 0").collect()
    assert len(held) > 100
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in held) >= 0.97 * len(held)
    every = scored.collect()
    assert len(every) == docs.count() and all(0 <= r.score <= 1 for r in every)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {2000, 2001} <= ids and None not in ids


def test_swapping_identity_terms_hardly_moves_the_score(toxic_tables):
    docs, labels = toxic_tables
    neutral, other = "the women in the garden", "the men in the garden"
    gaps = {}
    for penalty in (0.0, 1.0):
        scorer = toxicity.Scorer(toxicity.fit(docs, labels, penalty=penalty))
        gaps[penalty] = scorer.score(neutral) - scorer.score(other)
        if penalty:
            assert scorer.score(neutral) < 0.5
    assert abs(gaps[1.0]) < 0.2 * abs(gaps[0.0])


def test_toxicity_without_labels(spark, toxic_tables):
    docs, labels = toxic_tables
    assert {r.score for r in toxicity.add_score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    ones = labels.where("toxic = 1")
    assert {round(r.score, 6) for r in toxicity.add_score(docs, toxicity.fit(docs, ones)).collect()} == {1.0}
    assert toxicity.add_score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_scores_do_not_depend_on_partitions(toxic_tables):
    docs, labels = toxic_tables
    first = toxicity.fit(docs.repartition(7), labels.repartition(3))
    second = toxicity.fit(docs.coalesce(1), labels)
    assert first.weights.keys() == second.weights.keys()
    assert max(abs(first.weights[k] - second.weights[k]) for k in first.weights) < 1e-9


def plain_fit(docs, labels, shards):
    """The whole fit on the driver: the same features, shards, rounds and steps, in plain Python."""
    texts = {}
    for doc_id, text, _ in docs:
        texts.setdefault(doc_id, []).append(text)
    rows = [(i, label, sorted(toxicity.words_of(t))) for i, label in labels if i is not None and label is not None for t in texts.get(i, [])]
    rows = [row for row in rows if zlib.crc32(str(row[0]).encode()) % 5]
    total, ones = len(rows), sum(label for _, label, _ in rows)
    counts = {}
    for _, label, words in rows:
        for word in words:
            for feature in toxicity.features_of(word):
                seen = counts.setdefault(feature, [0, 0])
                seen[0] += label
                seen[1] += 1
    rate = ones / total
    names = sorted(f for f, (_, n) in counts.items() if n >= 3)
    assert len(names) <= toxicity.FEATURES
    place = {name: i for i, name in enumerate(names)}
    swaps = toxicity.swaps_of(toxicity.IDENTITY_GROUPS)

    def numbers(words):
        return sorted({place[f] for w in words for f in toxicity.features_of(w) if f in place})

    weights = [0.0] * len(names) + [math.log(ones / (total - ones))]
    bias = len(names)
    for _ in range(toxicity.ROUNDS):
        made = []
        for shard in range(toxicity.SHARDS):
            own = sorted((row for row in rows if shards[row[0]] == shard), key=lambda row: row[:2])
            if not own:
                continue
            w, squares = list(weights), [1e-2] * len(weights)
            for _ in range(toxicity.EPOCHS):
                for _, label, words in own:
                    at = [*numbers(words), bias]
                    slope = 1 / (1 + math.exp(-sum(w[i] for i in at))) - label
                    for i in at:
                        step = slope + toxicity.RIDGE * w[i]
                        squares[i] += step * step
                        w[i] -= toxicity.RATE * step / math.sqrt(squares[i])
                    if any(word in swaps for word in words):
                        other = [*numbers({swaps.get(word, word) for word in words}), bias]
                        gone, come = set(at) - set(other), set(other) - set(at)
                        change = sum(w[i] for i in at) - sum(w[i] for i in other)
                        factor = min(2 * toxicity.SWAP_PENALTY, 1 / max(1, len(gone) + len(come))) * change
                        for i in gone:
                            w[i] -= factor
                        for i in come:
                            w[i] += factor
            made.append((len(own), w))
        weights = [sum(n * w[i] for n, w in made) / total for i in range(len(weights))]
    assert rate
    return dict(zip(names, weights[:-1], strict=True)), weights[-1]


def test_fit_and_score_equal_a_plain_version(spark):
    docs, labels = labelled(random.Random(4), 150)
    docs += [(2000, None, "x"), (0, docs[1][1], "x")]
    labels += [(3, None), (None, 1), (2000, 0)]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels_df = spark.createDataFrame(labels, "doc_id long, toxic int")
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(toxicity.SHARDS)).alias("shard")
    shards = {r.doc_id: r.shard for r in labels_df.select("doc_id", shard).collect()}
    weights, intercept = plain_fit(docs, labels, shards)
    model = toxicity.fit(docs_df, labels_df)
    assert model.weights.keys() == weights.keys()
    assert max(abs(model.weights[k] - weights[k]) for k in weights) < 1e-6 and abs(model.intercept - intercept) < 1e-6
    for row in toxicity.add_score(docs_df, model, score_col="found").collect():
        present = {f for word in toxicity.words_of(row.text) for f in toxicity.features_of(word)}
        logit = intercept + sum(weights.get(f, 0.0) for f in present)
        assert abs(row.found - 1 / (1 + math.exp(-logit))) < 1e-6

"""The pipeline as a whole and its de-duplicating stages on odd rows."""

import hashlib
import random

import corpus_pipeline
import pyarrow as pa
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe
from pyspark.sql import functions as F
from pyspark.sql import types as T

import public_tokenizers
from kerbline.llm import common, exact_dedup, queries, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, id string, cls string"


def document(doc_id, text):
    return (doc_id, text, "en", "src0", len(text or ""), 5, "x", "y")


REPEATED = [
    (1, "same words here"), (1, "same words here"), (2, "alpha"), (3, "alpha"), (3, "other unique"),
    (None, "alpha"), (None, "alpha"), (None, "no other row has this"), (4, None), (5, ""),
]


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates])
@pytest.mark.parametrize("as_file", [True, False])
def test_one_row_of_each_text_stays(spark, tmp_path, drop, as_file):
    docs = spark.createDataFrame([document(*row) for row in REPEATED], SCHEMA)
    if as_file:
        docs.repartition(3).write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = drop(docs)
    assert kept.columns == docs.columns
    rows = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    expected = [(1, "same words here"), (2, "alpha"), (3, "other unique"), (None, "no other row has this"), (4, None)]
    assert rows == sorted(expected, key=repr)


def prose(rng, words):
    return " ".join(rng.choice(["road", "river", "stone", "tree", "cloud", "light", "paper", "glass"]) + str(rng.randrange(500)) for _ in range(words))


def tables(spark, folder, docs):
    rng = random.Random(8)
    items = [(i, prose(rng, 20)) for i in range(3)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(0, 40)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return items


def corpus():
    rng = random.Random(2)
    insult = "utterly vile scum idiots disgusting trash"
    rows = [(i, f"{prose(rng, 60)} {insult if i % 4 == 0 else 'a calm and quiet day'}") for i in range(60)]
    near = rows[41][1].split()
    near[30] = "changed"
    rows += [(100, rows[43][1].replace(" ", "\t")), (101, " ".join(near)), (102, None), (None, None), (None, prose(rng, 80)), rows[45], (45, prose(rng, 70))]
    return rows


def test_run_on_odd_rows(spark, tmp_path):
    rows = corpus()
    items = tables(spark, tmp_path, [document(*row) for row in rows])
    rows.append((103, f"before {items[1][1]} after " + prose(random.Random(6), 40)))
    spark.createDataFrame([document(*rows[-1])], SCHEMA).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in got]
    toxic = [i for i in range(60) if i % 4 == 0]
    assert not set(ids) & set(toxic)
    assert set(range(60)) - set(toxic) <= set(ids)
    assert 100 not in ids and 101 not in ids and 103 not in ids
    assert ids.count(45) == 2 and ids.count(None) == 1
    encoding = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=load_tiktoken_bpe(queries.VOCABULARY))
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, []).append(text or "")
    for row in got:
        decoded = [t for t in texts[row.doc_id] if hashlib.sha256(t.encode()).hexdigest() == row.decoded_sha256]
        assert decoded and row.n_tokens == len(encoding.encode_ordinary(decoded[0]))


def test_run_on_an_empty_table(spark, tmp_path):
    tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_stage_keeps_all_columns_in_place(spark, tmp_path):
    tables(spark, tmp_path, [document(*row) for row in corpus()])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("__row", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.drop("__row"), str(tmp_path)).schema.names == docs.columns[:-1]


def test_near_dedup_keeps_every_link_of_the_fingerprints(spark, tmp_path):
    """Texts of like fingerprints whose five-word sets are far apart: long runs of one phrase with unlike ends."""
    rng = random.Random(4)
    run = " ".join(["same old phrase"] * 300)
    texts = [f"{run} {prose(rng, 120)}", f"{run} {prose(rng, 120)}", prose(rng, 120)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    assert len(sets[0] & sets[1]) < 0.5 * len(sets[0] | sets[1])
    assert (simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).bit_count() <= simhash.MAX_BITS
    docs = spark.createDataFrame([document(i, text) for i, text in enumerate(texts)], SCHEMA)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()) == [0, 2]


def test_workers_get_batches_of_bounded_bytes(spark):
    """Long rows: what a worker holds of the JVM's batch, beside the slice it works on, is bounded."""
    rows = spark.range(300, numPartitions=1).select("id", F.repeat(F.lit("x"), 200_000).alias("text"))

    def work():
        return lambda texts: [pa.array([sum(b.size for b in texts.buffers() if b)] * len(texts), pa.int64())]

    made = common.map_arrow(rows, ["text"], ["id"], [T.StructField("held", T.LongType())], work).collect()
    assert sorted(row.id for row in made) == list(range(300))
    assert max(row.held for row in made) <= 2 * common.SLICE_BYTES

"""Language, quality and transcripts against plain versions and held-out rows."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import language, quality, queries, transcripts

SF = "/root/testdata/sf0.01"

# ---- language -----------------------------------------------------------------------------------

SAMPLE = [
    (1, "the cat sat on the mat and the dog", "en"),
    (2, "der hund und die katze sind im haus", "de"),
    (3, "le chat est sur la table et le chien", "fr"),
    (4, "the house is on the hill", "en"),
    (5, "das haus ist auf dem berg", "de"),
    (6, "la maison est sur la colline", "fr"),
    (7, "unlabelled text", None),
    (8, None, "fr"),
    (9, "", "en"),
    (4, "the house is on the hill", "en"),
]


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame([(*row, "clash") for row in SAMPLE], "doc_id long, text string, lang string, lang_pred string")


def plain_language(text, rows):
    """The same method over dictionaries, without limits on the vocabulary."""
    words, grams = {}, {}
    for _, sample_text, lang in rows:
        if lang:
            for word in language.words_of(sample_text):
                words.setdefault(lang, Counter())[word] += 1
                for size in language.GRAM_SIZES:
                    grams.setdefault((lang, size), Counter()).update(language.grams_of(word, size))
    langs = sorted(words)
    sums = dict.fromkeys(langs, 0.0)

    def log(counts, item):
        return math.log((counts[item] + language.SMOOTHING) / (sum(counts.values()) + language.SMOOTHING * len(counts)))

    for word in language.words_of(text):
        if any(word in words[lang] for lang in langs):
            for lang in langs:
                sums[lang] += log(words[lang], word)
            continue
        for size in language.GRAM_SIZES:
            known = [g for g in language.grams_of(word, size) if any(g in grams[lang, size] for lang in langs)]
            if known:
                for lang in langs:
                    sums[lang] += sum(log(grams[lang, size], g) for g in known) / len(known)
                break
    best = max(langs, key=lambda lang: sums[lang])
    return best, 1 / sum(math.exp(value - sums[best]) for value in sums.values())


def test_language_equals_plain_version(sample):
    model = language.fit(sample)
    scorer = language.Scorer(model)
    for text in ("the catty houses", "katzen im haus", "la chatte", "xylophon", "日本", "the " * 5000, "mat mat tisch"):
        lang, score = scorer.predict(text)
        expected, share = plain_language(text, SAMPLE)
        assert lang == expected and score == pytest.approx(share, abs=1e-9)


def test_language_of_odd_rows(spark, sample):
    model = language.fit(sample)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the mat")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.add_language(docs, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en"
    assert language.add_language(sample, model).columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    none = language.fit(sample.limit(0))
    assert {r.lang_pred for r in language.add_language(docs, none).collect()} == {"und"}
    assert language.add_language(docs.limit(0), model).count() == 0


def test_language_memo_is_bounded(sample, monkeypatch):
    model = language.fit(sample)
    expected = language.Scorer(model).predict("zug zoo zap the cab der hun mat")
    monkeypatch.setattr(language, "MEMO_ENTRIES", 4)
    scorer = language.Scorer(model)
    for _ in range(3):
        lang, score = scorer.predict("zug zoo zap the cab der hun mat")
        assert lang == expected[0] and score == pytest.approx(expected[1])


def test_language_query_on_held_out_rows(spark):
    got = queries.op8_language_id(spark, SF).where("held_out")
    rows = got.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


# ---- quality ------------------------------------------------------------------------------------


def test_quality_query_on_held_out_rows(spark):
    got = queries.op9_quality(spark, SF)
    assert got.count() == 1000
    rows = got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)


def quality_tables(spark, labels):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        good = i % 2
        text = " ".join(rng.choices("alpha beta gamma delta epsilon".split(), k=30)) if good else "BUY!! NOW$$$ " * 20
        rows.append((i, text, "en" if good else "xx", f"s{good}", len(text), "clash"))
    rows += [(200, None, None, None, None, None), (201, "", "en", "s1", 0, ""), (None, "text", "en", "s1", 4, ""), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    known = [(i, i % 2) for i in range(0, 90)] if labels else []
    known += [(3, None), (None, 1), (999, 1)] if labels else []
    return docs, spark.createDataFrame(known, "doc_id long, quality int"), spark.createDataFrame([(1, "h"), (1, "a")], "doc_id long, host string")


def test_quality_of_odd_rows(spark):
    docs, labels, hosts = quality_tables(spark, True)
    rows = quality.quality_scores(docs, labels, hosts).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    right = [(r.score >= 0.5) == (r.doc_id % 2 == 1) for r in rows if r.doc_id is not None and r.doc_id < 120]
    assert sum(right) >= 0.95 * len(right)


def test_quality_scores_equal_a_plain_combination(spark):
    """Both views' calibrated log-odds less the prior's, from the fitted numbers."""
    docs, labels, hosts = quality_tables(spark, True)
    rows = quality.stored(quality.views(docs, hosts, "doc_id", "text"), "test-views")
    model = quality.fit(rows, labels)
    mean, deviation = (np.array(v) for v in (model.scaler.mean, model.scaler.std))
    got = {r.id: r.score for r in quality.score(rows, model).collect()}

    def odds(part, vector):
        raw = float(np.dot(part.classifier.coefficients.toArray(), vector)) + part.classifier.intercept
        return part.slope * raw + part.offset

    for row in rows.collect():
        raw = np.array(row.text_raw.toArray())
        assert raw == pytest.approx(quality.text_features(dict((d.doc_id, d.text) for d in docs.collect())[row.id]))
        scaled = np.divide(raw - mean, deviation, out=np.zeros_like(raw), where=deviation > 0)
        total = odds(model.text, scaled) + odds(model.meta, row.meta.toArray()) - np.log(model.prior / (1 - model.prior))
        assert got[row.id] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-6)


def test_the_pool_is_all_unlabelled_rows(spark, monkeypatch):
    docs, labels, hosts = quality_tables(spark, True)
    seen, train = [], quality.confident

    def watched(pool, classifier, vector):
        seen.append(sorted(r.id for r in pool.select("id").collect()))
        return train(pool, classifier, vector)

    monkeypatch.setattr(quality, "confident", watched)
    rows = quality.stored(quality.views(docs, hosts, "doc_id", "text"), "test-views")
    quality.fit(rows, labels)
    known = {r.doc_id for r in labels.collect()}
    ids = [r.doc_id for r in docs.collect()]
    expected = sorted(i for i in ids if i is not None and i not in known and zlib.crc32(str(i).encode()) % quality.FOLDS != quality.HELD_OUT_FOLD)
    assert len(seen) == 2 * quality.ROUNDS and all(pool == expected for pool in seen)


def test_quality_without_labels_or_documents(spark):
    docs, labels, hosts = quality_tables(spark, False)
    assert {r.score for r in quality.quality_scores(docs, labels, hosts).collect()} == {0.0}
    assert quality.quality_scores(docs.limit(0), labels, hosts.limit(0)).count() == 0


# ---- transcripts --------------------------------------------------------------------------------


def best_path(model, messages):
    """Viterbi by trying every sequence of roles."""
    codes = [(code, i, number) for number, message in enumerate(messages) for i, code in enumerate(message)]
    best, best_roles = -math.inf, None
    for roles in itertools.product(range(len(transcripts.ROLES)), repeat=len(codes)):
        score = 0.0
        for at, (code, i, number) in enumerate(codes):
            within = model.marked if code // transcripts.MARKER_BASE < len(transcripts.ROLES) else model.within
            change = within if i else model.between
            score += (model.first[roles[0]] if at == 0 else change[roles[at - 1], roles[at]]) + model.emit[code][roles[at]]
        if score > best + 1e-12:
            best, best_roles = score, list(roles)
    return best, best_roles


def some_model(seed):
    rng = np.random.default_rng(seed)
    return transcripts.model_of(
        rng.integers(1, 50, 3).astype(float), rng.integers(1, 50, (3, 3)).astype(float), [rng.integers(1, 50, (3, n)).astype(float) for n in transcripts.SIZES]
    )


def chat_rows(seed, turns):
    rng = random.Random(seed)
    pieces = ["User: hi", "why?", "- item", "Assistant: sure", "x" * 50, "", "### System", "fine", "y" * 200]
    rows = []
    for conv in range(4):
        for turn in range(turns):
            rows.append((conv, turn, "\n".join(rng.choices(pieces, k=rng.randint(1, 2))), "user", "clash"))
    return rows


CHAT = "conv_id long, turn long, text string, role string, part string"


@pytest.mark.parametrize("block_turns", [512, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_roles_equal_exhaustive_search(spark, monkeypatch, seed, block_turns):
    monkeypatch.setattr(transcripts, "BLOCK_TURNS", block_turns)
    model, rows = some_model(seed), chat_rows(seed, 5)
    got = transcripts.format_chats(spark.createDataFrame(rows, CHAT).repartition(3), model).collect()
    for conv in range(4):
        texts = [text for c, _, text, *_ in rows if c == conv]
        _, roles = best_path(model, [transcripts.observe(text) for text in texts])
        at, expected = 0, []
        for turn, text in enumerate(texts):
            size = text.count("\n") + 1
            made = transcripts.turns_of(text, roles[at : at + size])
            expected += [(turn, part, role, content) for part, (role, content) in enumerate(made)]
            at += size
        assert sorted((r.turn, r.part, r.role, r.content) for r in got if r.conv_id == conv) == sorted(expected)


def test_one_long_conversation_is_decoded_in_blocks(spark, monkeypatch):
    model = some_model(7)
    rows = [(1, t, text, "user", "") for t, (_, _, text, *_) in enumerate(chat_rows(7, 60))]
    whole = sorted(map(repr, transcripts.format_chats(spark.createDataFrame(rows, CHAT), model).collect()))
    monkeypatch.setattr(transcripts, "BLOCK_TURNS", 7)
    assert sorted(map(repr, transcripts.format_chats(spark.createDataFrame(rows, CHAT), model).collect())) == whole


def test_markers_split_a_pasted_transcript(spark):
    chats = spark.createDataFrame([(i, t, f"text {t}\nmore", "user" if t % 2 == 0 else "assistant", "") for i in range(9) for t in range(4)], CHAT)
    model = transcripts.fit(chats)
    pasted = "System: be brief\nUser: what is it?\n**Assistant:** a thing\nand more\n<|user|> ok"
    got = transcripts.format_chats(spark.createDataFrame([(1, 0, pasted, None, "")], CHAT), model).orderBy("part").collect()
    assert [(r.role, r.content) for r in got] == [
        ("system", "be brief"), ("user", "what is it?"), ("assistant", "a thing\nand more"), ("user", "ok")
    ]
    assert got[0].rendered == "<|system|>\nbe brief\n<|end|>"


def test_odd_chat_rows(spark):
    rows = [(1, 0, None, "user", ""), (1, None, "", None, ""), (None, 0, "a", "tool", ""), (2, 0, "x", "user", ""), (2, 0, "x", "user", ""), (3, -5, "z" * 100_000, "assistant", "")]
    chats = spark.createDataFrame(rows, CHAT)
    got = transcripts.format_chats(chats, transcripts.fit(chats)).collect()
    assert len(got) == len(rows)
    assert got and {len(r.content) for r in got if r.conv_id == 3} == {100_000}
    none = chats.limit(0)
    assert transcripts.format_chats(none, transcripts.fit(none)).count() == 0


def test_chat_query_recovers_held_out_roles(spark):
    got = queries.op1_chat_formatting(spark, SF).where("held_out and part = 0").select("conv_id", "turn", F.col("role").alias("found"))
    rows = got.join(spark.read.parquet(f"{SF}/conversations.parquet"), ["conv_id", "turn"]).collect()
    assert len(rows) > 50 and sum(r.found == r.role for r in rows) >= 0.9 * len(rows)

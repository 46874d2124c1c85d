"""Language scores by a model that tasks do not hold whole."""

import pytest
from pyspark.sql import functions as F

from kerbline.llm import language

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("held", [1, 40])
def test_scores_do_not_depend_on_what_tasks_hold(spark, held):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, None, None), (-2, "12 !!", None), (-3, "xylophonzug qqq", None), (-4, "日本", None), (-3, "the häuser, der-die", None), (None, "la maison", None)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    rows = docs.where(F.pmod("doc_id", F.lit(3)) == 0)
    whole = language.fit(rows, words=10**9, grams=10**9)
    part = language.fit(rows, words=held, grams=held)
    assert whole.whole and not part.whole
    by_text = lambda model: {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language.add_language(docs, model).collect()}
    expected, got = by_text(whole), by_text(part)
    assert got.keys() == expected.keys() and language.add_language(docs, part).count() == docs.count()
    for key, (lang, score) in expected.items():
        assert got[key] == (lang, pytest.approx(score, abs=1e-9)), key


def test_words_held_for_one_language_have_their_counts_in_all(spark):
    rows = [("ja ja ja nein nein wort", "de"), ("ja yes yes yes yes no no no", "en")]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), words=2, grams=2)
    logs = model.word_logs[model.words["ja"]]
    assert logs[model.langs.index("en")] == pytest.approx(language.np.log(1.5) - language.np.log(8 + 3 * language.SMOOTHING))


@pytest.mark.parametrize("held", [1, 10**9])
def test_numbers_that_are_no_digits_are_no_letters(spark, held):
    rows = spark.createDataFrame([("la maison ½ bleue", "fr"), ("the house Ⅷ", "en")], "text string, lang string")
    texts = ["½ ²", "Ⅷ", "①", "Ⅷmaison½", "maison", "42 !!", "٣"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.add_language(docs, language.fit(rows, words=held, grams=held)).collect()}
    assert sorted(i for i, found in got.items() if found == ("und", 0.0)) == [0, 1, 2, 5, 6]
    assert got[3] == got[4] and got[3][0] == "fr"

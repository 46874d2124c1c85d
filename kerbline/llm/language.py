"""Language identification with word-first backoff (operator 8).

A word that the model knows is scored by its log frequency in each language. A word it does not know falls back to
its character n-grams: of the lengths ``GRAM_SIZES``, longest first, the first length at which the model knows any
n-gram of the word counts, with the mean log frequency of those known. A word without a known n-gram says
nothing. The language with the largest sum over all words of the text wins (of equal sums the first in
alphabetical order); the score is its posterior share with equal priors.

Word and n-gram counts cover all training documents, combined per batch and before the shuffle, and all of them
score. A model of at most ``WORDS`` words and ``GRAMS`` n-grams of each length per language is held by the tasks, which
then score texts whole, in place. Of a larger one they hold the ``WORDS`` most frequent words of each language, with their
counts in all languages; the other words of a text are counted, scored once per distinct word by joins with the
stored counts, and their scores added to the text's. The result does not depend on what is held. Letters are those that
Unicode classes as such: other numbers (½, Ⅷ, ①) are not. Texts that are null or have no letter get ``und`` and score 0; without training rows every text does.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import map_arrow, ship_package, stored

#: What tasks hold of the model, per language.
WORDS = 30_000
GRAMS = 10_000
GRAM_SIZES = (5, 4, 3, 2, 1)
#: Added to every count.
SMOOTHING = 0.5
UNKNOWN = "und"
#: Tokens a worker remembers beyond the model's words.
MEMO_ENTRIES = 300_000

#: Letters, and the numbers that are neither digits nor letters.
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text."""
    found = LETTERS.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [word for run in found for word in "".join(c if c.isalpha() else " " for c in run).split()]


def grams_of(word: str, size: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


# ---- fitting ------------------------------------------------------------------------------------


def count_words(batches):
    for batch in batches:
        tokens: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            tokens.setdefault(lang, Counter()).update((text or "").lower().split())
        # Words never go over white space, so each distinct token is cut into words once.
        counts: Counter = Counter()
        for lang, seen in tokens.items():
            for token, n in seen.items():
                for word in words_of(token):
                    counts[lang, word] += n
        langs, words = zip(*counts, strict=True) if counts else ((), ())
        columns = [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])


def count_grams(batches):
    for batch in batches:
        counts = Counter()
        columns = [batch.column(name).to_pylist() for name in ("lang", "word", "n")]
        for lang, word, n in zip(*columns, strict=True):
            for size in GRAM_SIZES:
                for gram in grams_of(word, size):
                    counts[lang, size, gram] += n
        langs, sizes, grams = zip(*counts, strict=True) if counts else ((), (), ())
        columns = [pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(grams, pa.string())]
        columns.append(pa.array(counts.values(), pa.int64()))
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "size", "item", "n"])


@dataclass
class Model:
    """Log frequencies per language (columns) of known words and of n-grams by length."""

    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[int, dict[str, int]]
    gram_logs: dict[int, np.ndarray]
    #: The stored counts behind a model that tasks do not hold whole; stays on the driver.
    stored: StoredCounts | None = None
    whole: bool = True

    def word_row(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return self.word_logs[known]
        for size in GRAM_SIZES:
            index = self.grams.get(size, {})
            rows = [index[gram] for gram in grams_of(word, size) if gram in index]
            if rows:
                return self.gram_logs[size][rows].mean(axis=0)
        return np.zeros(len(self.langs))

    @cached_property
    def scorer(self) -> Scorer:
        """Lasts as long as the model does in a worker, over all its tasks."""
        return Scorer(self)

    def __getstate__(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name != "scorer"} | {"stored": None}


def grams_of_rows(words: DataFrame, size: int) -> DataFrame:
    """``word, item`` for each n-gram of each word (column ``item``), as ``grams_of`` gives them."""
    marked, length = F.concat(F.lit("^"), "item", F.lit("$")), F.lit(size)
    starts = F.sequence(F.lit(1), F.length(marked) - (size - 1))
    grams = F.transform(starts, lambda at: marked.substr(at, length))
    return words.where(F.length(marked) >= size).select(F.col("item").alias("word"), F.explode(grams).alias("item"))


@dataclass
class StoredCounts:
    """``lang, size, item, n`` of all words (size 0) and n-grams, and the total and number of kinds by language and size."""

    counts: DataFrame
    sums: dict[tuple[str, int], tuple[int, int]]

    def logs(self, items: DataFrame, size: int, langs: list[str]) -> DataFrame:
        """``item, logs`` of those of ``items`` that were counted at this size."""
        found = items.join(self.counts.where(F.col("size") == size), "item").groupBy("item").pivot("lang", langs).agg(F.sum("n"))
        columns = []
        for lang in langs:
            total, kinds = self.sums.get((lang, size), (0, 0))
            n = F.coalesce(F.col(f"`{lang}`"), F.lit(0))
            columns.append(F.log(n + F.lit(SMOOTHING)) - float(np.log(total + SMOOTHING * max(kinds, 1))))
        return found.select("item", F.array(*columns).alias("logs"))

    def word_logs(self, words: DataFrame, langs: list[str]) -> DataFrame:
        """``item, logs`` of each word (column ``item``) that is known itself or by an n-gram."""
        made = stored(self.logs(words, 0, langs), "language-known")
        left = stored(words.join(made, "item", "left_anti"), "language-left")
        for size in GRAM_SIZES:
            pieces = grams_of_rows(left, size)
            known = self.logs(pieces.select("item").distinct(), size, langs)
            means = pieces.join(known, "item").groupBy(F.col("word").alias("item"))
            means = means.agg(F.array(*(F.avg(F.col("logs")[i]) for i in range(len(langs)))).alias("logs"))
            means = stored(means, "language-backoff")
            made = made.union(means)
            left = stored(left.join(means, "item", "left_anti"), "language-left")
            if left.isEmpty():
                break
        return made


def log_table(counts: dict[str, dict[str, int]], langs: list[str], totals: dict[str, int], kinds: dict[str, int]):
    """Row number by item, and log frequencies; an item that a language does not have has its smoothed zero count."""
    index = {item: i for i, item in enumerate(sorted(counts))}
    table = np.zeros((len(index), len(langs)))
    for column, lang in enumerate(langs):
        below = np.log(totals.get(lang, 0) + SMOOTHING * max(kinds.get(lang, 0), 1))
        values = np.array([counts[item].get(lang, 0) for item in index], float)
        table[:, column] = np.log(values + SMOOTHING) - below
    return index, table


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows of each language, those above the count at which more would be too many.

    The counts are decided by how many items have each, so that no task ranks the items of a language; items that tie
    at the limit are left out together.
    """
    kinds = counts.groupBy("lang", "n").agg(F.count("*").alias("kinds"))
    above = Window.partitionBy("lang").orderBy(F.col("n").desc())
    least = kinds.withColumn("held", F.sum("kinds").over(above)).where(F.col("held") <= limit).groupBy("lang").agg(F.min("n").alias("least"))
    # One row per language.
    return counts.join(F.broadcast(least), "lang").where("n >= least").drop("least")


def fit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", words: int = WORDS, grams: int = GRAMS
) -> Model:
    """The model of the rows of ``docs`` with a language."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null")
    counted = rows.mapInArrow(count_words, "lang string, word string, n long")
    counted = stored(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    gram_rows = counted.mapInArrow(count_grams, "lang string, size int, item string, n long")
    gram_rows = stored(gram_rows.groupBy("lang", "size", "item").agg(F.sum("n").alias("n")), "language-grams")
    word_rows = counted.select("lang", F.lit(0).alias("size"), F.col("word").alias("item"), "n")
    every = word_rows.union(gram_rows)
    sums = {
        (row.lang, row.size): (row.total, row.kinds)
        for row in every.groupBy("lang", "size").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).collect()
    }
    langs = sorted({lang for lang, _ in sums})
    whole = all(kinds <= (grams if size else words) for (_, size), (_, kinds) in sums.items())
    # At most ``words`` + 5 * ``grams`` items per language, each with its counts in all languages.
    held = every
    if not whole:
        top = stored(most_frequent(word_rows, words).select("item").distinct(), "language-held")
        held = word_rows.join(F.broadcast(top), "item", "left_semi").select(*every.columns)
    tables: dict[int, dict[str, dict[str, int]]] = {size: {} for size in (0, *GRAM_SIZES)}
    for row in held.toLocalIterator():
        tables[row.size].setdefault(row.item, {})[row.lang] = row.n
    made = {}
    for size, counts in tables.items():
        totals = {lang: sums.get((lang, size), (0, 0))[0] for lang in langs}
        kinds = {lang: sums.get((lang, size), (0, 0))[1] for lang in langs}
        made[size] = log_table(counts, langs, totals, kinds)
    gram_index = {size: made[size][0] for size in GRAM_SIZES}
    gram_logs = {size: made[size][1] for size in GRAM_SIZES}
    return Model(langs, made[0][0], made[0][1], gram_index, gram_logs, StoredCounts(every, sums), whole)


# ---- scoring ------------------------------------------------------------------------------------


class Scorer:
    """Scores texts; rows of tokens are remembered behind the model's, up to a fixed count.

    The row of a token (what stands between white space) is the sum of the rows of its words. If the model is not
    held whole, words that are not held are left to the caller.
    """

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, len(model.words)
        self.table = np.zeros((self.known + MEMO_ENTRIES + 1, max(1, len(model.langs))))
        self.table[: self.known] = model.word_logs if self.known else 0
        self.start()

    def start(self) -> None:
        self.memo = _Memo(self)
        self.memo.update(self.model.words)
        self.open = np.zeros(len(self.table), bool)
        self.others: dict[int, list[str]] = {}
        # The row of all tokens without letters, zero.
        self.silent = self.size = self.known
        self.table[self.silent] = 0
        self.size += 1

    def add(self, token: str) -> int:
        words = words_of(token)
        if not words:
            return self.silent
        if len(words) == 1 and words[0] in self.model.words:
            return self.model.words[words[0]]
        at = self.size
        if not self.model.whole and (others := [word for word in words if word not in self.model.words]):
            self.open[at], self.others[at] = True, others
            words = [word for word in words if word in self.model.words]
        self.table[at] = sum(map(self.model.word_row, words), np.zeros(len(self.model.langs)))
        self.size += 1
        return at

    def parts(self, text: str | None) -> tuple[np.ndarray, bool, Counter]:
        """Sums of the words held, whether there is any word, and the counts of the words not held."""
        tokens, spoken, others = (text or "").lower().split(), False, Counter()
        sums = np.zeros(len(self.model.langs))
        # In pieces, so that one text cannot fill the memo beyond its size.
        piece_size = MEMO_ENTRIES // 2
        for start in range(0, len(tokens) if self.model.langs else 0, piece_size):
            if self.size > self.known + piece_size:
                self.start()
            piece = tokens[start : start + piece_size]
            rows = np.fromiter(map(self.memo.__getitem__, piece), np.int64, len(piece))
            sums += self.table[rows].sum(axis=0)
            spoken = spoken or bool((rows != self.silent).any())
            for row in rows[self.open[rows]].tolist():
                others.update(self.others[row])
        return sums, spoken, others

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score, by a model that is held whole."""
        sums, spoken, _ = self.parts(text)
        if not spoken:
            return UNKNOWN, 0.0
        best = int(sums.argmax())
        return self.model.langs[best], float(1 / np.exp(sums - sums[best]).sum())


class _Memo(dict):
    def __init__(self, scorer: Scorer) -> None:
        super().__init__()
        self.scorer = scorer

    def __missing__(self, token: str) -> int:
        row = self[token] = self.scorer.add(token)
        return row


def add_language(
    docs: DataFrame,
    model: Model,
    text_col: str = "text",
    lang_col: str = "lang_pred",
    score_col: str = "score",
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` (all columns by default, but those named like the new ones), the language and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [name for name in (docs.columns if keep is None else keep) if name not in (lang_col, score_col)]
    if not model.whole:
        return add_by_joins(docs, model, shared, text_col, lang_col, score_col, keep)

    def work():
        scorer = shared.value.scorer

        def compute(texts: pa.Array) -> list[pa.Array]:
            made = [scorer.predict(text) for text in texts.to_pylist()]
            return [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]

        return compute

    added = [T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())]
    return map_arrow(docs, [text_col], keep, added, work)


def add_by_joins(docs: DataFrame, model: Model, shared, text_col: str, lang_col: str, score_col: str, keep: list[str]) -> DataFrame:
    """``add_language`` for a model that tasks do not hold whole."""
    langs, entry = model.langs, pa.struct([("item", pa.string()), ("n", pa.int64())])

    def work():
        scorer = shared.value.scorer

        def compute(texts: pa.Array) -> list[pa.Array]:
            made = [scorer.parts(text) for text in texts.to_pylist()]
            others = [[{"item": item, "n": n} for item, n in m[2].items()] for m in made]
            sums = pa.array([m[0].tolist() for m in made], pa.list_(pa.float64()))
            return [sums, pa.array([m[1] for m in made], pa.bool_()), pa.array(others, pa.list_(entry))]

        return compute

    other = T.StructType([T.StructField("item", T.StringType()), T.StructField("n", T.LongType())])
    added = [
        T.StructField("__sums", T.ArrayType(T.DoubleType())),
        T.StructField("__spoken", T.BooleanType()),
        T.StructField("__others", T.ArrayType(other)),
    ]
    rows = map_arrow(docs, [text_col], keep, added, work).withColumn("__row", F.monotonically_increasing_id())
    rows = stored(rows, "language-rows")
    others = rows.select("__row", F.inline("__others"))
    words = stored(others.select("item").distinct(), "language-others")
    found = others.join(model.stored.word_logs(words, langs), "item").groupBy("__row")
    found = found.agg(F.array(*(F.sum(F.col("n") * F.col("logs")[i]) for i in range(len(langs)))).alias("__more"))
    found = found.withColumnRenamed("__row", "__of")
    sums = F.coalesce(F.zip_with("__sums", "__more", lambda a, b: a + b), "__sums")
    joined = rows.join(found, F.col("__row") == F.col("__of"), "left").withColumn("__sums", sums)
    best = F.array_max("__sums")
    named = F.array(*map(F.lit, langs))[(F.array_position("__sums", best) - 1).cast("int")]
    share = 1 / F.aggregate(F.transform("__sums", lambda value: F.exp(value - best)), F.lit(0.0), lambda a, b: a + b)
    return joined.select(
        *(F.col(f"`{name}`") for name in keep),
        F.when(F.col("__spoken"), named).otherwise(F.lit(UNKNOWN)).alias(lang_col),
        F.when(F.col("__spoken"), share).otherwise(F.lit(0.0)).alias(score_col),
    )

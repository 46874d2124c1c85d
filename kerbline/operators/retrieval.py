"""Keyword retrieval: rank documents by how many distinct query words occur in their text.

A word counts when it is a substring of the lower-cased text. Words contain no white space, so a
word occurs in a text exactly when it occurs in one of the text's tokens.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.operators.lookup import MAX_BROADCAST_ROWS, fits_broadcast, lookup, measured, spread_join
from kerbline.session import pin, store

MAX_INLINE_QUERIES = 1_000
MAX_INLINE_BYTES = 1024 * 1024
MAX_INLINE_WORDS = 256  # beyond, one search per word and document costs more than tokenizing
MAX_WORDS_PER_TOKEN = 256  # beyond, one search per word and token costs more than the index of their pieces
GRAM = 3  # characters of the pieces by which words and tokens meet
CHUNK = 256
TOKENS_PER_TASK = 200_000
COMMON_SHARE = 20  # a word is common when more than one in this many documents has it
WHITE_SPACE = r"(?U)[\s\x1c-\x1f]+"


def words_of(text: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), WHITE_SPACE), lambda w: w != ""))


def retrieve(
    queries: DataFrame, docs: DataFrame, k: int = 2, max_inline: int = MAX_INLINE_QUERIES
) -> DataFrame:
    """The k best documents per distinct query: ``query``, ``rank``, ``score`` and the document.

    ``queries`` has ``query``; ``docs`` has ``doc_ord`` (unique, document order) and ``text``.
    Documents that match no word are left out; equal scores keep document order.
    """
    distinct = pin(queries.select("query").where(F.col("query").isNotNull()).distinct())
    inline = _inline(distinct, max_inline)
    if inline is None:
        # Queries may be whole texts: their numbers stand for them in all that is shuffled.
        texts = pin(distinct.select(F.monotonically_increasing_id().alias("_number"), "query"))
        asked = texts.select(F.col("_number").alias("query"), F.explode(words_of(F.col("query"))).alias("word"))
        scored = _score_by_tokens(asked, docs, k)
    else:
        scored = _score_inline(inline, docs)
    # The rank limit is applied in every task before the shuffle, so a query that matches most
    # documents sends k rows per task, not all of its matches.
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_ord")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    columns = ["query", "rank", "score", "doc_ord", *[c for c in docs.columns if c != "doc_ord"]]
    if inline is not None and len(inline) * k <= MAX_BROADCAST_ROWS:
        return docs.join(F.broadcast(best), "doc_ord").select(*columns)
    if inline is None:
        best = pin(best).withColumnRenamed("query", "_number").join(texts, "_number").drop("_number")
    best = pin(best)
    if fits_broadcast(best):
        return docs.join(F.broadcast(best), "doc_ord").select(*columns)
    return lookup(best, docs, ["doc_ord"], small=False).select(*columns)


def contexts(
    queries: DataFrame, docs: DataFrame, k: int, width: int, default: str, max_inline: int = MAX_INLINE_QUERIES
) -> DataFrame:
    """One row per distinct query with the cut texts of its k best documents, or the default text."""
    distinct = pin(queries.select("query").distinct())
    return cut_texts(distinct, retrieve(distinct, docs, k, max_inline), k, width, default)


def cut_texts(distinct: DataFrame, found: DataFrame, k: int, width: int, default: str) -> DataFrame:
    """``query`` and ``context`` from documents retrieved before, of which the first k count."""
    cut = F.struct("rank", F.substring("text", 1, width).alias("cut"))
    parts = F.transform(F.sort_array(F.collect_list(cut)), lambda p: p.cut)
    joined = found.where(F.col("rank") <= k).groupBy("query").agg(F.array_join(parts, "; ").alias("context"))
    return distinct.join(joined, "query", "left").select(
        "query", F.coalesce("context", F.lit(default)).alias("context")
    )


def _inline(distinct: DataFrame, max_inline: int) -> list | None:
    """The queries and their words if few and short, else nothing; measured before they are read."""
    size = distinct.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("query")).alias("bytes")).first()
    if size["rows"] > max_inline or (size["bytes"] or 0) > MAX_INLINE_BYTES:
        return None
    rows = distinct.select("query", words_of(F.col("query")).alias("words")).collect()
    if len({w for r in rows for w in r["words"]}) > MAX_INLINE_WORDS:
        return None
    return [(r["query"], r["words"]) for r in rows]


def _score_inline(inline: list, docs: DataFrame) -> DataFrame:
    """Few queries and words: every document is scored against all of them where it is read.

    Each word is searched for once per document, and neither text nor pairs are shuffled.
    """
    words = sorted({w for _, ws in inline for w in ws})
    asked = [{"query": q, "words": ws} for q, ws in inline]
    word_list = F.from_json(F.lit(json.dumps(words)), F.lit("array<string>"))
    query_list = F.from_json(F.lit(json.dumps(asked)), F.lit("array<struct<query:string,words:array<string>>>"))
    # The lowered text is bound as a lambda variable: as a plain column the optimizer would merge it
    # into the search, which would lower the text anew for every word.
    search = F.transform(
        F.array(F.lower("text")), lambda low: F.filter(word_list, lambda w: F.contains(low, w))
    )
    present = docs.select("doc_ord", search[0].alias("_present"))
    hits = F.transform(
        query_list,
        lambda q: F.struct(
            q["query"].alias("query"), F.size(F.array_intersect(q["words"], F.col("_present"))).alias("score")
        ),
    )
    # Only queries with a word in the document leave its row.
    matched = F.filter(hits, lambda hit: hit["score"] > 0)
    return present.select("doc_ord", F.explode(matched).alias("hit")).select("hit.query", "doc_ord", "hit.score")


def _score_by_tokens(asked: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Many queries: substring search as equality joins over the vocabulary of distinct tokens.

    ``asked`` has ``query`` and ``word``. Which words a token holds is worked out once per distinct token of the corpus.
    Documents look up their tokens and are stored as a row each with the numbers of their words; then queries meet documents through their rare words first. A query's k-th best score by rare words is a
    floor, and a document can add one per common word at most: documents that cannot reach the floor are left
    out, which loses no result. Only queries whose common words alone could reach it are scored on all their words.
    """
    asked = pin(asked)
    words = pin(asked.select("word").distinct().withColumn("number", F.monotonically_increasing_id()))
    asked = pin(lookup(asked, words, ["word"]).select("query", F.col("number").alias("word")))
    tokens = docs.select("doc_ord", F.explode(words_of(F.col("text"))).alias("token"))
    held = pin(_words_in_tokens(tokens.select("token").distinct(), words))
    found = lookup(tokens, held, ["token"]).where(F.size("held") > 0).select("doc_ord", "held")
    # A token's words travel to their document as one short list, and a document's words are stored as one list.
    doc_words = found.repartition("doc_ord").groupBy("doc_ord")
    doc_words = store(doc_words.agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("words")), "doc-words")
    by_doc = doc_words.select("doc_ord", F.explode("words").alias("word"))

    common_from = docs.count() / COMMON_SHARE
    spread = by_doc.groupBy("word").agg((F.count(F.lit(1)) > common_from).alias("common"))
    asked = store(lookup(asked, pin(spread), ["word"]).where(F.col("common").isNotNull()), "asked")
    rare = store(_counted(by_doc, asked.where(~F.col("common"))), "rare-scores")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc_ord")
    floors = rare.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= k).groupBy("query")
    floors = floors.agg(F.max(F.when(F.col("_place") == k, F.col("score"))).alias("floor"))
    addable = asked.groupBy("query").agg(F.count_if("common").alias("addable"))
    bounds = lookup(addable, store(floors, "floors"), ["query"]).withColumn("floor", F.coalesce("floor", F.lit(1)))
    bounds = store(bounds, "bounds")

    whole = bounds.where(F.col("addable") >= F.col("floor")).select("query", F.lit(True).alias("whole"))
    known = lookup(asked, whole, ["query"])
    by_all_words = _counted(by_doc, known.where("whole").select("query", "word"))
    kept = bounds.where(F.col("addable") < F.col("floor"))
    near = lookup(rare, kept, ["query"]).where(F.col("score") + F.col("addable") >= F.col("floor"))
    near = store(near.select("query", "doc_ord", "score"), "near")
    common = known.where("whole is null and common").groupBy("query").agg(F.collect_set("word").alias("common"))
    near = lookup(near, store(common, "common-words"), ["query"]).join(doc_words, "doc_ord")
    added = F.size(F.array_intersect(F.coalesce("common", F.array().cast("array<long>")), "words"))
    by_bound = near.select("query", "doc_ord", (F.col("score") + added).cast("int").alias("score"))
    return by_all_words.unionByName(by_bound)


def _counted(by_doc: DataFrame, asked: DataFrame) -> DataFrame:
    """How many of the asked words each document has, per query. A document's rows in ``by_doc`` lie together, so tasks count them."""
    pairs = spread_join(by_doc, asked.select("query", "word"), "word", "doc_ord")
    return pairs.groupBy("query", "doc_ord").agg(F.count(F.lit(1)).cast("int").alias("score"))


def _words_in_tokens(vocabulary: DataFrame, words: DataFrame) -> DataFrame:
    """``token`` and, in ``held``, the numbers of the ``words`` (``word, number``) in it; a token has few pieces, so the list is short."""
    # The vocabulary is small in bytes but costly per row: pinned first, a width by its rows then keeps
    # it from being merged into a few tasks.
    numbered = pin(vocabulary.withColumn("_token", F.monotonically_increasing_id()))
    width = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = max(width, -(-numbered.count() // TOKENS_PER_TASK))
    spread = numbered.repartition(width, "_token")
    number, small = measured(words)
    if small and number <= MAX_WORDS_PER_TOKEN:
        listed = F.from_json(
            F.lit(json.dumps([r.asDict() for r in words.collect()])), F.lit("array<struct<word:string,number:bigint>>")
        )
        inside = F.filter(listed, lambda w: F.contains(F.col("token"), w["word"]))
        return spread.select("token", F.transform(inside, lambda w: w["number"]).alias("held"))
    return numbered.join(_held_by_grams(spread, words, small), "_token").select("token", "held")


def _grams(text: str, size: Column, last: Column) -> Column:
    """The pieces of ``size`` characters that begin at the first ``last`` characters of a text, with their places."""
    starts = F.sequence(F.lit(1), F.least(F.length(text) - size + 1, last))
    return F.transform(starts, lambda at: F.struct(at.alias("at"), F.substring(text, at, size).alias("gram")))


def _held_by_grams(tokens: DataFrame, words: DataFrame, small: bool) -> DataFrame:
    """``_token`` and the numbers of the words it holds, by a positional index of pieces of ``GRAM`` characters.

    Each word is listed under one of its pieces, the one that fewest tokens hold, with its offset. A token meets a word
    where it holds that piece, and holds the word if the characters around the piece are the word's. So what is compared
    grows with the tokens' pieces and the hits, not with the lengths of the words. Words shorter than ``GRAM`` are their
    own piece. Tokens are cut into overlapping chunks first, so that a very long one is not copied per piece.
    """
    words = words.withColumn("_size", F.least(F.length("word"), F.lit(GRAM)))
    seen = words.agg(F.collect_set("_size").alias("sizes"), F.max(F.length("word")).alias("longest")).first()
    sizes, longest = sorted(seen["sizes"]), seen["longest"] or 1
    chunks = F.transform(
        F.sequence(F.lit(1), F.length("token"), F.lit(CHUNK)),
        lambda start: F.substring("token", start, F.lit(CHUNK + longest - 1)),
    )
    cut = tokens.select("_token", F.explode(chunks).alias("chunk"))
    # A word that begins in a chunk's own characters has its piece at most as far again behind them.
    reach = F.lit(2 * CHUNK)
    cut = cut.withColumn("_size", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>")))
    cut = cut.where(F.length("chunk") >= F.col("_size"))
    pieces = cut.select("_token", "chunk", "_size", F.inline(_grams("chunk", F.col("_size"), reach)))
    counts = store(pieces.groupBy("_size", "gram").agg(F.count(F.lit(1)).alias("_rows")), "gram-counts")
    listed = words.select("word", "number", "_size", F.inline(_grams("word", F.col("_size"), F.lit(CHUNK))))
    listed = listed.join(counts, ["_size", "gram"])
    rarest = listed.groupBy("word", "number").agg(F.min(F.struct("_rows", "at", "gram")).alias("best"), F.count(F.lit(1)).alias("_known"))
    # A word of which some piece is in no token is in no token itself.
    pieces_of_word = F.least(F.length("word"), F.lit(CHUNK + GRAM - 1)) - F.least(F.length("word"), F.lit(GRAM)) + 1
    rarest = rarest.where(F.col("_known") == pieces_of_word)
    anchors = rarest.select("word", "number", F.col("best.gram").alias("gram"), (F.col("best.at") - 1).alias("offset"))
    met = spread_join(pieces.select("_token", "chunk", "at", "gram"), store(anchors, "anchors"), "gram", "_token")
    begins = F.col("at") - F.col("offset")
    met = met.where((begins >= 1) & (F.substring("chunk", begins, F.length("word")) == F.col("word")))
    return met.groupBy("_token").agg(F.collect_set("number").alias("held"))

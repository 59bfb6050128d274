"""Substring statistics decided per distinct word: a dictionary with a trigram index instead of a scan of every text for every token.

A token of word characters can only occur inside a maximal run of word characters, so how often a text contains it is the sum over the text's words of how often each word does.
Texts become (id, word, n) once; tokens meet the *dictionary* of distinct words through grams of three characters (two for tokens of two, the token itself for one), each by its rarest gram, and
what matches joins the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgraph.storage import kept, spread

from . import patterns
from .retrieval import EXPANSIONS, LIGHT, OVERTAKING, _any, density_query

#: Questions that one pass over the texts' facts sends to every task.
QUESTION_BLOCK = 20_000
WORD = r"[^\p{L}\p{N}_]+"


def word_counts(texts: DataFrame) -> DataFrame:
    """(id, word, n) of texts (id, low)."""
    return texts.select("id", F.explode(F.filter(F.split("low", WORD), lambda w: w != "")).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))


def _grams(word: Column, size: int) -> Column:
    """Distinct grams of ``size`` characters; none of a shorter word."""
    last = F.char_length(word) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(word, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def gram_index(words: DataFrame, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(gram, word) for grams of the given sizes of distinct words (word)."""
    return words.select("word", F.explode(F.concat(*[_grams(F.col("word"), k) for k in sizes])).alias("gram"))


def containing(index: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, word, times) for every word that holds a token (non-empty, word characters), and how often without overlaps.

    A token is looked up by the rarest of its grams of the longest size it has."""
    size = F.least(F.char_length("token"), F.lit(3))
    own = tokens.select("token").distinct().select("token", F.when(size == 3, _grams(F.col("token"), 3)).when(size == 2, _grams(F.col("token"), 2)).otherwise(_grams(F.col("token"), 1)).alias("grams"))
    each = own.select("token", F.explode("grams").alias("gram"))
    asked = kept(index.join(each.select("gram").distinct(), "gram", "left_semi"), "asked-grams")
    frequency = asked.groupBy("gram").agg(F.count("*").alias("words"))
    # a gram that no word has is the rarest of all, and then no word holds the token
    rarest = each.join(frequency, "gram", "left").withColumn("place", F.row_number().over(W.partitionBy("token").orderBy(F.coalesce("words", F.lit(0)), "gram"))).where("place = 1").select("token", "gram")
    met = asked.join(rarest, "gram").where(F.contains("word", F.col("token")))
    times = (F.char_length("word") - F.char_length(F.replace("word", F.col("token")))) / F.char_length("token")
    return met.select("token", "word", times.alias("times"))


def token_frequencies(counts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(id, token, tf) of the tokens that a text contains as substrings. counts: :func:`word_counts`."""
    wanted = kept(tokens.select("token").distinct(), "tokens")
    sizes = tuple(sorted(r[0] for r in wanted.select(F.least(F.char_length("token"), F.lit(3))).distinct().collect() if r[0]))
    index = gram_index(counts.select("word").distinct(), sizes or (3,))
    hits = kept(containing(index, wanted), "token-words")
    return counts.join(hits, "word").groupBy("id", "token").agg(F.sum(F.col("n") * F.col("times")).alias("tf"))


def lexical_densities(texts: DataFrame, questions: DataFrame) -> DataFrame:
    """ST-20, SE-08, SO-11 for every text (id, text) and question (query_id, text): query_id, id, density, as :func:`lexgraph.operators.retrieval.lexical_density` defines it.

    Tokens are decided per word, bigrams by one automaton pass over the texts, phrases once per text and once per question."""
    asked = kept(questions.select("query_id", density_query(F.col("text")).alias("a"), "text").select("query_id", "a.tokens", F.col("a.bigrams").alias("pairs"), F.col("a.lights").alias("lights"), _mask(F.lower(F.coalesce("text", F.lit(""))), 0).alias("mask")), "questions")
    lowered = spread(texts.select("id", "text")).select("id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    counts = kept(word_counts(lowered), "word-counts")
    tokens = asked.select("query_id", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token"))
    found = token_frequencies(counts, tokens).join(tokens, "token").groupBy("query_id", "id").agg(F.count("*").alias("matched"), F.sum("tf").alias("tf"))
    pairs = asked.select("query_id", F.explode("pairs").alias("pattern")).groupBy("query_id", "pattern").agg(F.count("*").alias("times"))
    met = patterns.contained(lowered.select("id", F.col("low").alias("text")), pairs)
    bigrams = met.join(pairs, "pattern").groupBy("query_id", "id").agg((2 * F.sum("times")).alias("bigrams"))
    overtakes = F.contains("low", F.lit(OVERTAKING)) & ~F.contains("low", F.lit(LIGHT))
    facts = kept(lowered.select("id", (F.col("low") == "").alias("blank"), _mask(F.col("low"), 1).alias("text_mask"), overtakes.alias("overtakes")), "text-facts")
    # every text gets a row for every question: that is the result. The questions are a few numbers each; blocks of them are sent to every task
    few = asked.select("query_id", F.size("tokens").alias("n_tokens"), "lights", "mask")
    blocks = -(-few.count() // QUESTION_BLOCK) or 1
    every = None
    for block in range(blocks):
        part = facts.join(F.broadcast(few if blocks == 1 else few.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)))
        every = part if every is None else every.union(part)
    joined = every.join(found, ["query_id", "id"], "left").join(bigrams, ["query_id", "id"], "left")
    matched, tf = F.coalesce("matched", F.lit(0)), F.coalesce("tf", F.lit(0.0))
    bonus = F.coalesce("bigrams", F.lit(0)) + 3 * F.bit_count(F.col("mask").bitwiseAND(F.col("text_mask"))) - F.when(F.col("lights") & F.col("overtakes"), 4).otherwise(0)
    score = matched / F.col("n_tokens") * 10 + F.least(tf, F.lit(20.0)) * 0.1 + bonus
    nothing = F.col("blank") | (F.col("n_tokens") == 0) | (matched == 0) & (bonus <= 0)
    return joined.select("query_id", "id", F.when(nothing, F.lit(0.0)).otherwise(F.round(F.greatest(score, F.lit(0.0)), 4)).alias("density"))


def _mask(low: Column, side: int) -> Column:
    """Groups of phrases that a question asks for (side 0) or a text answers (side 1), a bit each."""
    bits = F.lit(0)
    for k, group in enumerate(EXPANSIONS):
        bits = bits + F.when(_any(low, group[side]), F.lit(1 << k)).otherwise(0)
    return bits



"""Spelling variants of words by wildcard groups, without a pair of words.

Two words that differ in one replaced letter share exactly one group (position, prefix, suffix), written as
the word with a wildcard in that place. A group keeps its size and its two best words: the best of the others
is for each member the first or, for the first itself, the second. A word with one letter more meets the
shorter one where one of its deletions is a word of the vocabulary: there the word learns how many longer
words there are and which is best, and each of these learns of the word. What a word has in its groups is
added up; no pair of words is ever made.

A wildcard group has at most as many members as there are letters, and a deletion belongs to at most
(length + 1) * letters words, so no key is hot whatever the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import discard, materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A sign that is no letter of a word.
WILD = "*"


def without(word: Column, at: Column) -> Column:
    """``word`` less its code point number ``at``, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def _key(word: Column) -> Column:
    """What a word or a group is dealt out by: itself, or its digest where it is long, so that no row is a long key."""
    return F.when(F.length(word) > 100, F.concat(F.lit("#"), F.sha2(word, 256))).otherwise(word)


def runs_of_letters(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a row a match of ``pattern`` in the text: its columns and ``run``, A to Z in lower case."""
    found = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)))
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "run")], found.alias("run")).withColumn("run", F.translate("run", UPPER, UPPER.lower()))


def _replaced(words: DataFrame) -> DataFrame:
    """(word, others, best): for each group of a word with other members how many these are, and their best."""
    at = F.col("at")
    key = F.concat(F.substring("word", F.lit(1), at), F.lit(WILD), F.substring(F.col("word"), at + 2, F.length("word")))
    rows = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("at")).select(_key(key).alias("key"), "word", "n")
    group = Window.partitionBy("key")
    ranked = group.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct((-F.col("n")).alias("less"), "word")
    known = rows.select("word", (F.count(F.lit(1)).over(group) - 1).alias("others"), F.first(me).over(ranked).alias("one"), F.nth_value(me, 2).over(ranked).alias("two"))
    return known.where("others > 0").select("word", "others", F.when(F.col("one.word") == F.col("word"), F.col("two")).otherwise(F.col("one")).alias("best"))


def _shifted(words: DataFrame, least_length: int) -> DataFrame:
    """(word, others, best) for words one letter longer or shorter."""
    at = F.col("at")
    # of a run of one letter only the first: the others give the same deletion
    first = (at == 0) | (F.substring(F.col("word"), at + 1, F.lit(1)) != F.substring(F.col("word"), at, F.lit(1)))
    longer = words.where(F.length("word") > least_length).select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("at")).where(first)
    longer = longer.select(_key(without(F.col("word"), at)).alias("key"), "word", "n", F.lit(False).alias("own"))
    rows = longer.unionByName(words.select(_key(F.col("word")).alias("key"), "word", "n", F.lit(True).alias("own")))
    group = Window.partitionBy("key")
    me = F.struct((-F.col("n")).alias("less"), "word")
    known = rows.select(
        "word", "own", F.count(F.when(~F.col("own"), 1)).over(group).alias("longer"),
        F.min(F.when(~F.col("own"), me)).over(group).alias("best_longer"), F.min(F.when(F.col("own"), me)).over(group).alias("shorter"),
    )
    # the word itself has the longer ones, each of these has the word
    out = known.where("(own AND longer > 0) OR (NOT own AND shorter IS NOT NULL)")
    return out.select("word", F.when(F.col("own"), F.col("longer")).otherwise(F.lit(1)).alias("others"), F.when(F.col("own"), F.col("best_longer")).otherwise(F.col("shorter")).alias("best"))


def neighbours(words: DataFrame, least_length: int = 1) -> DataFrame:
    """(word, n, n_near, best_n, best) for rows (word, n), words distinct.

    ``n_near`` counts the words that differ by exactly one inserted, deleted or replaced code point; ``best``
    is that of largest n, of several the smallest. ``least_length``: no word is shorter.
    """
    nothing = F.lit(None).cast("struct<less:bigint,word:string>")
    own = words.select("word", F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("others"), nothing.alias("best"))
    near = _replaced(words).unionByName(_shifted(words, least_length)).select("word", F.lit(None).cast("long").alias("n"), F.col("others").cast("long"), "best")
    out = own.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.sum("others").alias("n_near"), F.min("best").alias("best"))
    return out.select("word", "n", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(word, root), written, for rows (word, form): the end of each word's path of forms.

    Paths double a round; a path has no cycle, because n grows along it.
    """
    now = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(most_rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moving = not step.where("moved").isEmpty()
        discard(now)
        now = step
        if not moving:
            return now.select("word", "root")
    raise RuntimeError("a path of forms doesn't end")


def group_variants(words: DataFrame, ratio: int = 10, least_length: int = 1) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for rows (word, n).

    A word's form is its best near word if that one's n is at least ``ratio`` times the word's, else null; its
    root is where its forms end, the word itself where it has none. Rows that repeat a word are added up; a
    null word or count is left out; no words give no rows.
    """
    words = words.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialise(words, "spelling-words")
    has = F.col("best_n") >= ratio * F.col("n")
    known = neighbours(words, least_length).select("word", "n", "n_near", F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
    known = materialise(known, "spelling-known")
    discard(words)
    ends = roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

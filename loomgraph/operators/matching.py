"""Loose matching of names at scale: candidates by equi-joins that lose no pair, then the exact predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.names import name_match, name_tokens, plain_name

#: characters of a plain name by which a name inside another is found; shorter names go by what they have
GRAM = 6


def loose_pairs(names: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of distinct names (column name) for which name_match holds.

    One name inside the other: the inner one's first GRAM characters stand somewhere in the outer one; names shorter
    than that are looked up by their own length, so each length below GRAM costs one more key a position.  Two words
    in common: the pair of words is a key.  One word in common and one that differs by an edit: the common word and
    the other with any one letter left out are a key, so only near words meet.
    """
    rows = names.select("name", plain_name(F.col("name")).alias("plain"), F.array_sort(F.array_distinct(name_tokens(F.col("name")))).alias("words")).where("plain <> ''")
    pairs = _inside(rows).union(_two_words(rows)).union(_one_edit(rows))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    return pairs.where(name_match(F.col("a"), F.col("b")))


def _met(keyed: DataFrame, other: DataFrame) -> DataFrame:
    return keyed.select("key", F.col("name").alias("a")).join(other.select("key", F.col("name").alias("b")), "key").where("a <> b").select("a", "b")


def _inside(rows: DataFrame) -> DataFrame:
    size = F.length("plain")
    inner = rows.select("name", F.substring("plain", 1, GRAM).alias("key"))
    # the lengths that keys have: GRAM, and those of shorter names
    lengths = [r[0] for r in rows.select(F.least(size, F.lit(GRAM)).alias("n")).distinct().collect()]
    grams = [_grams(n) for n in lengths]
    outer = rows.select("name", F.explode(F.array_distinct(F.flatten(F.array(*grams)))).alias("key")) if grams else inner
    return _met(inner, outer)


def _grams(n: int):
    last = F.greatest(F.length("plain") - n + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.col("plain"), i, F.lit(n)))


def _two_words(rows: DataFrame) -> DataFrame:
    w = F.col("words")
    pairs = F.flatten(F.transform(w, lambda x, i: F.transform(F.slice(w, i + 2, F.size(w)), lambda y: F.concat_ws(" ", x, y))))
    keyed = rows.where(F.size(w) >= 2).select("name", F.explode(pairs).alias("key"))
    return _met(keyed, keyed)


def _one_edit(rows: DataFrame) -> DataFrame:
    w = F.col("words")

    def around(word):
        """The word and what is left of it without any one letter: words an edit apart share one of these."""
        gaps = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
        return F.array_union(F.array(word), gaps)

    # the odd word out, and all the others as they are: the other words must be the same
    odd = F.transform(w, lambda x: F.struct(x.alias("odd"), F.array_join(F.array_remove(w, x), " ").alias("rest")))
    keyed = rows.where(F.size(w) >= 2).select("name", F.explode(odd).alias("o")).where("length(o.odd) >= 4")
    keyed = keyed.select("name", "o.rest", F.explode(around(F.col("o.odd"))).alias("gap")).select("name", F.concat_ws("|", "rest", "gap").alias("key"))
    return _met(keyed, keyed)

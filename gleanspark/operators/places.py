"""Places of a table of any size, looked for in texts.

Whole names are found by an index on their first word: every word of a text brings along as many characters as the longest name has,
meets the names that begin with it, and is then held against the whole name. Names anywhere in a text, also inside a word, are found by
the automaton of the keyword rules. Of several names in a text the one that stands first in the table counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import keywords


def _whole_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``(key, place)`` by names as whole words; no text is shuffled but the beginnings of words that names begin with too."""
    word = r"(?U)^\w+"
    index = names.where(F.col("name").rlike(r"(?U)^\w(.*\w)?$")).withColumn("word", F.regexp_extract("name", word, 0))
    longest = index.agg(F.max(F.length("name"))).first()[0] or 1
    # at every begin of a word, what follows up to the longest name and one character more
    ahead = F.regexp_extract_all("text", F.lit(rf"(?sU)\b(?=\w)(?=(.{{1,{longest + 1}}}))"), F.lit(1))
    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    rows = numbered.select("key", "row", F.explode_outer(F.array_distinct(ahead)).alias("ahead"))
    rows = rows.withColumn("word", F.coalesce(F.regexp_extract("ahead", word, 0), F.lit("")))
    # a row without words or names stays, with rows that meet nothing
    met = rows.join(index, "word", "left")
    ends = ~F.substring("ahead", F.length("name") + 1, F.lit(1)).rlike(r"(?U)^\w")
    best = F.when(F.startswith("ahead", "name") & ends, F.struct("position", "place"))
    found = met.groupBy("row").agg(F.first("key").alias("key"), F.min(best).alias("best"))
    return found.select("key", F.col("best.place").alias("place"))


def place_by_table(df: DataFrame, places: DataFrame, key: str, text: str = "text", whole_word: bool = True) -> DataFrame:
    """``(key, place)`` for every row: the place of least position that its text names, null without one.

    ``places`` has ``(position, place)``; null and empty places are left out, and of a name that stands there twice the first counts. Upper and lower
    case are alike. As whole words, names that do not begin and end with a letter or a digit are not found. Keys may be null or repeated.
    """
    named = F.struct(F.col("position").cast("int").alias("position"), "place")
    # once each, however often the table names them: else every text meets all repeats
    names = places.where("place <> ''").groupBy(F.lower("place").alias("name")).agg(F.min(named).alias("first")).select("first.*", "name")
    texts = df.select(df[key].alias("key"), F.lower(F.coalesce(df[text], F.lit(""))).alias("text"))
    if whole_word:
        found = _whole_names(texts, names)
    else:
        rules = names.select(F.col("place").alias("category"), F.col("position").alias("ord"), F.lit("").alias("tier"), F.col("name").alias("keyword"))
        empty = F.lit("").alias("description"), F.lit("").alias("company")
        parts = keywords.search(texts.select("key", F.col("text").alias("title"), *empty), rules, keywords.firsts)
        if len(parts) > 1:
            rows = reduce(DataFrame.unionByName, parts)
            each = rows.groupBy("row").agg(F.first("key").alias("key"), F.min(F.array_min("found")).alias("best"))
        else:
            each = parts[0].select("key", F.array_min("found").alias("best"))
        found = each.select("key", F.col("best.category").alias("place"))
    return found.withColumnRenamed("key", key)

"""Resolution of names to a registry of people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .substrings import contained


def registry(rows: DataFrame) -> DataFrame:
    """People (person, name, aliases) with a person and a name; others, and further rows of a person, are left out."""
    good = rows.where((F.coalesce("person", F.lit("")) != "") & (F.coalesce(F.trim("name"), F.lit("")) != ""))
    return good.groupBy("person").agg(F.min(F.struct("name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))).alias("r")).select("person", "r.name", "r.aliases")


def resolve(mentions: DataFrame, people: DataFrame) -> DataFrame:
    """(mention, person, how) for mentions (mention, a string): a cascade, in which each step sees what the steps before left.

    exact: the normalised name or alias; ends: first and last word; lower: the lower-case name as it stands; part: the
    normalised mention stands anywhere in the lower-case names of one person alone. Names of several people resolve to
    the least person, but in the last step to none.
    """
    names = people.select("person", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).distinct()
    words = lambda c: F.filter(F.split(T.person_name(F.col(c)), " "), lambda w: w != "")
    ends = lambda c: F.concat_ws(" ", F.element_at(words(c), 1), F.element_at(words(c), -1))
    left = mentions.select("mention").where("mention is not null").distinct()
    found = None
    steps = (("exact", T.person_name(F.col("mention")), T.person_name(F.col("name")), F.lit(True)), ("ends", ends("mention"), ends("name"), F.size(words("mention")) > 1), ("lower", F.lower("mention"), F.lower("name"), F.lit(True)))
    for how, mine, theirs, able in steps:
        keys = names.where(F.size(words("name")) > 1).select(theirs.alias("key"), "person") if how == "ends" else names.select(theirs.alias("key"), "person")
        keys = keys.where("key <> ''").groupBy("key").agg(F.min("person").alias("person"))
        hit = left.where(able).withColumn("key", mine).join(keys, "key").select("mention", "person", F.lit(how).alias("how"))
        left = left.join(hit, "mention", "left_anti")
        found = hit if found is None else found.unionByName(hit)
    texts = names.select(F.lower("name").alias("text")).distinct().withColumn("id", F.sha2("text", 256))
    part = contained(left.select(T.person_name(F.col("mention")).alias("needle")), texts).join(texts, "id").join(names.select("person", F.lower("name").alias("text")).distinct(), "text")
    one = part.groupBy("needle").agg(F.min("person").alias("person"), F.max("person").alias("other")).where("person = other")
    return found.unionByName(left.withColumn("needle", T.person_name(F.col("mention"))).join(one, "needle").select("mention", "person", F.lit("part").alias("how")))

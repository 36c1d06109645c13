"""The tiered near-duplicate gate for batches of new entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..sources.scratch import cut, discard
from .similarity import similar


def fingerprinted(entries: DataFrame) -> DataFrame:
    return entries.withColumn("fingerprint", T.fingerprint(F.col("content"), F.col("user_id"), F.col("content_type"), F.col("subject")))


def exact(entries: DataFrame) -> DataFrame:
    """Add duplicate_of: the first live entry by arrival with the same user and fingerprint, null for that entry itself and for flagged ones.

    The first is found by an aggregate and joined back, so no window holds a group of copies.
    """
    rows = fingerprinted(entries)
    first = rows.where("flag is null").groupBy("user_id", "fingerprint").agg(F.min_by("id", "ord").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    dup = F.when(F.col("flag").isNull() & (F.col("first_id") != F.col("id")), F.col("first_id"))
    return rows.join(first.drop("copies"), ["user_id", "fingerprint"], "left").withColumn("duplicate_of", dup).drop("first_id")


def insert_if_absent(existing: DataFrame, new: DataFrame, head: int | None = 300) -> DataFrame:
    """Rows of new to store: one a content hash, the first by arrival, and none whose hash exists."""
    known = existing.select(T.content_hash(F.col("content"), head).alias("hash")).distinct()
    hashed = new.withColumn("hash", T.content_hash(F.col("content"), head))
    first = hashed.groupBy("hash").agg(F.min("ord").alias("first_ord"))
    return hashed.join(first, "hash").where("ord = first_ord").join(known, "hash", "left_anti").drop("first_ord")


def insert_or_get(existing: DataFrame, new: DataFrame, head: int | None = None) -> DataFrame:
    """(id, stored_id, is_new) for each new row (id, ord, content): the id under which its content is stored, which is its own if it is the first of its hash."""
    known = existing.select(T.content_hash(F.col("content"), head).alias("hash"), "id", F.col("ord")).groupBy("hash").agg(F.min_by("id", "ord").alias("known_id"))
    hashed = new.select("id", "ord", T.content_hash(F.col("content"), head).alias("hash"))
    first = hashed.groupBy("hash").agg(F.min_by("id", "ord").alias("first_id"))
    j = hashed.join(first, "hash").join(known, "hash", "left")
    return j.select("id", F.coalesce("known_id", "first_id").alias("stored_id"), (F.col("known_id").isNull() & (F.col("id") == F.col("first_id"))).alias("is_new"))


def judged(candidates: DataFrame, answers: DataFrame, own: Sequence[str] = ()) -> DataFrame:
    """Add relation to candidates (band, and new_content and candidate_content or their key): duplicate in the refuse band, the judge's cached answer in the confirm band, else null.

    answers has key (text.pair_key of the two contents) and answer, the judge's raw text; a pair without an answer has
    null. Each key's answer is read once, so a judge is called on `unjudged` keys only. Pairs of the same contents share
    it, unless both tables have the columns `own`, as the ids of a pair: then an answer is for that pair alone.
    """
    keyed = candidates if "key" in candidates.columns else candidates.withColumn("key", T.pair_key(F.col("new_content"), F.col("candidate_content")))
    known = answers.groupBy("key", *own).agg(F.first("answer").alias("answer"))
    j = keyed.join(known, ["key", *own], "left")
    relation = F.when(F.col("band") == "refuse", "duplicate").when((F.col("band") == "confirm") & F.col("answer").isNotNull(), rules.model_relation(F.col("answer")))
    return j.withColumn("relation", relation).drop("key", "answer")


def unjudged(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """The distinct keys and contents of the confirm band that have no answer yet."""
    keyed = candidates.where("band = 'confirm'").withColumn("key", T.pair_key(F.col("new_content"), F.col("candidate_content")))
    return keyed.select("key", "new_content", "candidate_content").dropDuplicates(["key"]).join(answers.select("key"), "key", "left_anti")


def _reaching(new: DataFrame, existing: DataFrame, keys: list[str], refuse: float | None, confirm: float | None, carried: Sequence[str] = (), top: int | None = None) -> DataFrame:
    """(a, b, sim) of new and existing entries that agree in keys and reach the confirm similarity, with what similar carries; with top all that can be among the first `top` of a, and others."""
    least = rules.CONFIRM if confirm is None or refuse is None or refuse < confirm else confirm
    return similar(new.select("id", "vec", *keys, *carried), existing.select("id", "vec", *keys, *carried), keys, least, carried=carried, top=top).where("a <> b")


def candidates(new: DataFrame, existing: DataFrame, keys: list[str], refuse: float | None = None, confirm: float | None = None, top: int = 5) -> DataFrame:
    """(id, candidate, sim, place, band): the nearest `top` live entries that agree in keys and reach the confirm similarity.

    new and existing have id, vec and keys, and content_type; an entry is no candidate of itself.
    """
    pairs = _reaching(new, existing, keys, refuse, confirm, top=top)
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    near = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    types = new.select(F.col("id").alias("a"), F.col("content_type").alias("t"))
    r, c = rules.thresholds(F.col("t"), refuse, confirm)
    return near.join(types, "a").select(F.col("a").alias("id"), F.col("b").alias("candidate"), "sim", "place", rules.band(F.col("sim"), r, c).alias("band"))


def _column(df: DataFrame, name: str, default: Column) -> Column:
    return (F.col(name) if name in df.columns else default).alias(name)


def decide(new: DataFrame, existing: DataFrame, keys: list[str], refuse: float | None = None, confirm: float | None = None) -> DataFrame:
    """(id, decision, against, sim): exact, refuse, confirm or pass for each new entry, in their order, as if they came one by one.

    new and existing have id, ord (unique), content, content_type, user_id, subject, flag and vec. An entry is held
    against the live existing entries and the new ones before it that passed: one that was turned away turns nothing
    away. New entries with forced (where new has it) pass without being held against any. An existing entry with born
    or died (where existing has them) counts for new entries after born and before died alone. Existing entries that have
    their fingerprint need no content.

    The order is kept by rounds: an entry is turned away once an earlier one that passed is its copy or reaches the
    confirm similarity, and passes once all earlier ones like it were turned away. Each round writes its state; a round
    decides the first entry at least, and all at once where chains of like entries are short.
    """
    columns = ["id", "ord", "user_id", "fingerprint", "content_type", "subject", "flag", "vec", *[k for k in keys if k not in ("content_type", "user_id", "subject")]]
    always = F.lit(None).cast("long")
    existing, new = existing if "fingerprint" in existing.columns else fingerprinted(existing), fingerprinted(new)
    old = existing.select(*columns, _column(existing, "born", always), _column(existing, "died", always), F.lit(False).alias("fresh"), F.lit(False).alias("forced"))
    fresh = new.select(*columns, always.alias("born"), always.alias("died"), F.lit(True).alias("fresh"), _column(new, "forced", F.lit(False)))
    rows = old.unionByName(fresh).where("flag is null")
    marked = cut(rows.select("id", "ord", "fresh", "forced", "born", "died", "user_id", "fingerprint", "content_type"))
    pool = rows.where("vec is not null")
    reaching = _reaching(pool.where("fresh and not forced"), pool, keys, refuse, confirm, ["ord", "fresh", "born", "died"])
    sided = reaching.select("a", "b", "sim", F.col("ord_a").alias("ord"), F.col("ord_b").alias("b_ord"), F.col("fresh_b").alias("b_fresh"), F.col("born_b").alias("born"), F.col("died_b").alias("died"))
    counts = (F.col("born").isNull() | (F.col("born") < F.col("ord"))) & (F.col("died").isNull() | (F.col("died") > F.col("ord"))) & (~F.col("b_fresh") | (F.col("b_ord") < F.col("ord")))
    edges = cut(sided.where(counts).select("a", "b", "sim", "b_fresh", "b_ord"))
    copies = marked.select("id", "ord", "fresh", "forced", "born", "died", F.sha2(F.to_json(F.struct("user_id", "fingerprint")), 256).alias("g"))
    several = copies.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    copies = cut(copies.join(several, "g"))
    dated = F.col("born").isNotNull() | F.col("died").isNotNull()
    groups = copies.where(~dated).select("id", "g", "fresh", F.struct(F.col("fresh").alias("late"), "ord").alias("at"))
    # copies of existing entries that count for a time only, and of which few have the same content
    spans = copies.where(dated).select("g", F.col("id").alias("s"), F.col("ord").alias("s_ord"), "born", "died")
    held = (F.col("born").isNull() | (F.col("born") < F.col("ord"))) & (F.col("died").isNull() | (F.col("died") > F.col("ord")))
    spanned = cut(copies.where("fresh and not forced").select("id", "ord", "g").join(spans, "g").where(held).groupBy("id").agg(F.min(F.struct(F.struct(F.lit(False).alias("late"), F.col("s_ord").alias("ord")).alias("at"), F.col("s").alias("id"))).alias("span")))
    passed = F.when(~F.col("fresh") | F.col("forced"), F.lit(True)).when(F.col("span").isNotNull(), F.lit(False))  # null: not decided yet
    state = cut(marked.select("id", "fresh", "forced").join(spanned, "id", "left").select("id", passed.alias("passed")))
    while True:
        near = edges.join(state.select(F.col("id").alias("b"), "passed"), "b").groupBy(F.col("a").alias("id")).agg(F.bool_or(F.coalesce("passed", F.lit(False))).alias("met"), F.count_if(F.col("passed").isNull()).alias("waits"))
        mates = groups.join(state, "id")
        firsts = mates.groupBy("g").agg(F.min(F.when(F.col("passed"), F.col("at"))).alias("there"), F.min(F.when(F.col("passed").isNull(), F.col("at"))).alias("next"))
        held = mates.join(firsts, "g").where(F.col("passed").isNull()).select("id", F.coalesce(F.col("there") < F.col("at"), F.lit(False)).alias("copied"), (F.col("at") > F.col("next")).alias("later"))
        j = state.join(near, "id", "left").join(held, "id", "left")
        out = F.coalesce("met", F.lit(False)) | F.coalesce("copied", F.lit(False))
        free = (F.coalesce("waits", F.lit(0)) == 0) & ~F.coalesce("later", F.lit(False))
        state, before = cut(j.select("id", F.coalesce("passed", F.when(out, F.lit(False)).when(free, F.lit(True))).alias("passed"))), state
        discard(before)
        if state.where("passed is null").isEmpty():
            break
    passed = state.where("passed").select("id")
    best = edges.join(passed.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.max_by(F.struct("sim", "b"), F.struct("sim", ~F.col("b_fresh"), -F.col("b_ord"))).alias("n"))
    kept = groups.join(passed, "id").groupBy("g").agg(F.min(F.struct("at", "id")).alias("first"))
    copy = groups.join(kept, "g").where("first.at < at").select("id", "first").unionByName(spanned.select("id", F.col("span").alias("first")))
    copy = copy.groupBy("id").agg(F.min("first")["id"].alias("first_id"))
    r, c = rules.thresholds(F.col("content_type"), refuse, confirm)
    fresh = marked.where("fresh").select("id", "content_type", "forced").join(state, "id").join(copy, "id", "left").join(best, "id", "left")
    turned = ~F.col("passed")
    decision = F.when(turned & F.col("first_id").isNotNull(), "exact").when(turned, rules.band(F.col("n.sim"), r, c)).otherwise("pass")
    return fresh.select("id", decision.alias("decision"), F.when(turned, F.coalesce("first_id", "n.b")).alias("against"), F.when(turned & F.col("first_id").isNull(), F.col("n.sim")).alias("sim"))

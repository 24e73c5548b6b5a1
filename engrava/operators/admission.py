"""Admission gates, deduplication and cleanup of memories and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrava.functions import text as T
from engrava.plans.storage import join_small, materialize

#: Subjects that never name anything.
GENERIC_SUBJECTS = ["it", "this", "that", "they", "we", "you", "i", "he", "she"]


def admit_memories(rows: DataFrame, denied: list[str], least_chars: int = 20, least_words: int = 8) -> DataFrame:
    """``id, admit_reason``: the first gate that stops a memory, or ``admit``.

    The gates in order: a denied pattern, the same path and content as an earlier row, the same content as an earlier row from anywhere, too
    little signal. Earlier is by id. The texts are read once, where they lie: only hashes and flags are shuffled. Each duplicate gate joins the first ids of
    hashes that come more than once, an aggregate combined before its shuffle; a join by a hash that many rows share is split by AQE.
    """
    denied_now = F.lit(False)
    for p in denied:
        denied_now = denied_now | F.col("content").rlike(p)
    words = F.size(F.filter(F.split(F.col("content"), r"\s+"), lambda w: w != ""))
    low = (F.length("content") < least_chars) | ((words <= least_words) & ~F.col("content").contains("#important"))
    hashed = rows.select("id", T.hash_with_path(F.col("content"), F.col("source_file")).alias("h"), T.hash_content(F.col("content")).alias("c"), denied_now.alias("denied"), low.alias("low"))
    by_path, by_text = (hashed.groupBy(k).agg(F.min("id").alias(f"{k}_first"), F.count("*").alias(f"{k}_n")).where(F.col(f"{k}_n") > 1) for k in ("h", "c"))
    joined = hashed.join(by_path, "h", "left").join(by_text, "c", "left")
    reason = F.when(F.col("denied"), "denied").when(F.col("id") > F.col("h_first"), "same_path_and_content").when(F.col("id") > F.col("c_first"), "same_content").when(F.col("low"), "low_signal").otherwise("admit")
    return joined.select("id", reason.alias("admit_reason"))


def triple(subject="subject", predicate="predicate", obj="object") -> list[Column]:
    return [F.lower(F.trim(F.col(c))) for c in (subject, predicate, obj)]


def active(rows: DataFrame) -> DataFrame:
    """Not superseded, and in a live state."""
    return rows.where("superseded_by IS NULL AND state NOT IN ('retired', 'superseded')")


def duplicate_facts(rows: DataFrame) -> DataFrame:
    """Ids of active facts that repeat an earlier one's lower-cased triple."""
    s, p, o = triple()
    live = rows.where("superseded_by IS NULL").select("id", s.alias("s"), p.alias("p"), o.alias("o"))
    first = live.groupBy("s", "p", "o").agg(F.min("id").alias("first"))
    return live.join(first, ["s", "p", "o"]).where("id > first").select("id", "first")


def quality(rows: DataFrame) -> Column:
    """Confidence with a bonus for decisions and preferences, less for long or very short objects, between 0 and 1."""
    bonus = F.when(F.col("fact_type").isin("decision", "preference"), 0.1).otherwise(0.0)
    penalty = F.when(F.length("object") > 200, 0.2).when(F.length("object") < 2, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence") + bonus - penalty))


def excess_facts(rows: DataFrame, most: int) -> DataFrame:
    """Ids beyond the ``most`` best facts of each memory, by quality, then id."""
    rank = F.row_number().over(Window.partitionBy("memory_id").orderBy(F.desc("q"), "id"))
    return active(rows).withColumn("q", quality(rows)).withColumn("rank", rank).where(F.col("rank") > most).select("id", "memory_id", "rank")


def _one_edit(forms: DataFrame, threshold: float) -> DataFrame:
    """``x, y``: nodes of forms in one group that one edit parts, where the longer's length allows just one; each pair once, but for hashes that collide.

    Two of one length that differ in one place are equal without it, so they meet by that place and what is left; of two lengths the longer without one letter is the
    shorter. So however many forms a group has, as many meet as are alike, in runs of digits too, where all parts of a form are common.
    """
    one = lambda n: F.floor((1 - threshold) * n + 1e-9) == 1
    sized = forms.select("s", "p", "o", "node", F.length("o").alias("n"))
    places = lambda df: df.select("*", F.explode(F.sequence(F.lit(1), "n")).alias("i")).withColumn("rest", F.expr("concat(substring(o, 1, i - 1), substring(o, i + 1))"))
    keyed = places(sized.where(one(F.col("n")))).select(F.xxhash64("s", "p", "i", "rest").alias("key"), "node")
    swapped = keyed.toDF("key", "x").join(keyed.toDF("key", "y").hint("merge"), "key").where("x < y").select("x", "y")
    short = sized.where(one(F.col("n") + 1))
    lengths = materialize(short.select("s", "p", (F.col("n") + 1).alias("n")).distinct(), "object-lengths")
    long = places(join_small(sized.where(one(F.col("n"))), lengths, ["s", "p", "n"], "left_semi")).where("i = n OR substring(o, i, 1) <> substring(o, i + 1, 1)")
    dropped = long.select(F.xxhash64("s", "p", "rest").alias("key"), F.col("node").alias("x")).join(short.select(F.xxhash64("s", "p", "o").alias("key"), F.col("node").alias("y")).hint("merge"), "key")
    return swapped.unionByName(dropped.select("x", "y"))


def _similar_pairs(forms: DataFrame, threshold: float) -> DataFrame:
    """``first, node, similarity`` of all pairs of forms (``s, p, o, rank, node``) in one group that are as similar as ``threshold``, the lower rank first.

    Two forms whose words have the similarity share a word among the rarest of each, as many as may be missing and one; two within d edits share a run of q letters among
    the rarest ``d * q + 1`` of each (a repeated run counts as another). So only forms that share such a key meet, inside the join; where one edit is all that their
    lengths allow, ``_one_edit`` finds them. Forms too short for that, by their distance, meet all of their group; at 0.9 there are none.
    """
    forms = forms.where("o <> ''")
    q = 3 if threshold >= 0.85 else 2 if threshold >= 0.72 else 1
    most = F.floor((1 - threshold) * F.length("o") / threshold + 1e-9).cast("int")  # edits to the longest form that may be as similar
    words = F.array_distinct(F.split("o", " "))
    fewest = (F.size("w") - F.ceil(threshold * F.size("w") - 1e-9) + 1).cast("int")
    runs = forms.withColumn("edits", most).where("edits > 1").withColumn("n", F.greatest(F.length("o") - (q - 1), F.lit(0)))
    wide = runs.where(F.col("n") <= F.col("edits") * q)
    narrow = runs.where(F.col("n") > F.col("edits") * q)
    gram = F.explode(F.expr(f"transform(sequence(1, length(o) - {q - 1}), i -> substring(o, i, {q}))"))
    grams = narrow.select("node", (F.col("edits") * q + 1).alias("keep"), gram.alias("g")).groupBy("node", "keep", "g").agg(F.count("*").alias("k"))
    grams = grams.select("node", "keep", F.explode(F.expr("transform(sequence(1, cast(k as int)), i -> concat('r', i, ' ', g))")).alias("key"))
    tokens = forms.select("node", words.alias("w")).select("node", fewest.alias("keep"), F.explode("w").alias("key")).withColumn("key", F.concat(F.lit("w "), "key"))
    keys = materialize(grams.unionByName(tokens), "object-keys")
    rarest = keys.join(keys.groupBy("key").agg(F.count("*").alias("f")).hint("merge"), "key").groupBy("node", "keep", F.substring("key", 1, 1).alias("kind")).agg(F.sort_array(F.collect_list(F.struct("f", "key"))).alias("all"))
    kept = rarest.select("node", F.explode(F.slice("all", F.lit(1), F.col("keep"))).alias("x")).where("x.f > 1").select("node", F.col("x.key").alias("key"))
    keyed = materialize(forms.join(kept.hint("merge"), "node"), "object-signatures")
    a, b = (keyed.select("s", "p", "key", *[F.col(c).alias(f"{x}_{c}") for c in ("o", "rank", "node")]) for x in "ab")
    similar = T.normal_similarity(F.col("a_o"), F.col("b_o"))
    shape = F.abs(F.length("a_o") - F.length("b_o")) <= (1 - threshold) * F.greatest(F.length("a_o"), F.length("b_o")) + 1e-9
    near = (F.col("a_rank") < F.col("b_rank")) & (shape | F.startswith("key", F.lit("w "))) & (similar >= threshold)
    pairs = a.join(b.hint("merge"), ["s", "p", "key"]).where(near).select(F.col("a_node").alias("first"), F.col("b_node").alias("node"), similar.alias("similarity"))
    x, y = (df.select("s", "p", *[F.col(c).alias(f"{k}_{c}") for c in ("o", "rank", "node")]) for k, df in (("a", wide), ("b", forms)))
    ahead = F.col("a_rank") < F.col("b_rank")
    rest = x.join(y.hint("merge"), ["s", "p"]).where((F.col("a_node") != F.col("b_node")) & (similar >= threshold))
    rest = rest.select(F.when(ahead, F.col("a_node")).otherwise(F.col("b_node")).alias("first"), F.when(ahead, F.col("b_node")).otherwise(F.col("a_node")).alias("node"), similar.alias("similarity"))
    a, b = (forms.select("s", "p", *[F.col(c).alias(f"{k}_{c}") for c in ("o", "rank", "node")]) for k in "ab")
    near = materialize(_one_edit(forms, threshold), "one-edit").join(a.hint("merge"), F.col("x") == F.col("a_node")).withColumnsRenamed({"s": "_s", "p": "_p"}).join(b.hint("merge"), F.col("y") == F.col("b_node")).where((F.col("s") == F.col("_s")) & (F.col("p") == F.col("_p")) & (similar >= threshold))
    near = near.select(F.when(ahead, F.col("a_node")).otherwise(F.col("b_node")).alias("first"), F.when(ahead, F.col("b_node")).otherwise(F.col("a_node")).alias("node"), similar.alias("similarity"))
    return pairs.unionByName(rest).unionByName(near).distinct()


def similar_objects(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``loser_id, winner_id, similarity``: near-duplicate objects among valid facts of one subject and predicate, both in normal form.

    Facts go by confidence, then reinforced last (``created_at`` where there is no ``last_reinforced``), then the first. A fact loses to the winner before it whose object is most
    similar, of equals the first, if it is as similar as the threshold; else it wins itself. Equal normal forms are one row; pairs that are alike are found by
    the rare parts they share (``_similar_pairs``); and then all facts are decided whose forerunners are, round by round, so no group is gathered anywhere.
    Only sides that were counted are broadcast.
    """
    at = F.col("last_reinforced" if "last_reinforced" in rows.columns else "created_at")
    live = rows.where("superseded_by IS NULL").select("id", T.normal_object(F.col("subject")).alias("s"), T.normal_object(F.col("predicate")).alias("p"), T.normal_object(F.col("object")).alias("o"), F.struct(-F.col("confidence"), -F.unix_micros(at.cast("timestamp")), F.col("id")).alias("rank"))
    live = materialize(live, "objects")
    forms = live.groupBy("s", "p", "o").agg(F.min("rank").alias("rank"))
    forms = materialize(forms.select("s", "p", "o", "rank", F.col("rank.id").alias("node")), "object-forms")
    pairs = materialize(_similar_pairs(forms, threshold), "similar-objects")
    losers, open_ = None, pairs
    while True:  # a form waits while one before it, that isn't known to lose, waits
        waiting = open_.select(F.col("node").alias("first"), F.lit(True).alias("_waits")).distinct()
        decided = open_.join(waiting.hint("merge"), "first", "left").groupBy("node").agg(F.bool_or(F.col("_waits").isNotNull()).alias("_wait")).where("NOT _wait")
        round_ = materialize(decided.select("node"), "similar-round")
        losers = round_ if losers is None else losers.unionByName(round_)
        if round_.isEmpty():
            break
        open_ = materialize(join_small(join_small(open_, round_, "node", "left_anti"), round_.toDF("first"), "first", "left_anti"), "similar-open")
    # Every fact but the winners themselves, against the winners before it.
    winners = materialize(forms.join(losers.hint("merge"), "node", "left_anti"), "similar-winners").select(F.col("node").alias("winner_id"), F.col("rank").alias("_rank"))
    either = pairs.unionByName(pairs.select(F.col("node").alias("first"), F.col("first").alias("node"), "similarity"))
    either = either.unionByName(forms.where("o <> ''").select(F.col("node").alias("first"), "node", F.lit(1.0).alias("similarity")))
    rows_ = live.join(forms.select("s", "p", "o", "node").hint("merge"), ["s", "p", "o"]).select(F.col("id").alias("loser_id"), "rank", "node")
    met = rows_.join(either.join(winners.hint("merge"), F.col("first") == F.col("winner_id")).select("node", "winner_id", "_rank", "similarity").hint("merge"), "node").where(F.col("_rank") < F.col("rank"))
    best = met.groupBy("loser_id").agg(F.min_by(F.struct("winner_id", "similarity"), F.struct(-F.col("similarity"), F.col("_rank"))).alias("b"))
    return best.select("loser_id", "b.winner_id", "b.similarity")


def storable(rows: DataFrame, denied_subjects: list[str] | None = None) -> DataFrame:
    """Facts whose subject says something and whose object isn't a bare number."""
    return rows.where(~F.lower("subject").isin(denied_subjects or GENERIC_SUBJECTS) & ~F.col("object").rlike(r"^[0-9.]+$") & (F.length(F.trim("subject")) > 0))


def delete_facts(ids: DataFrame, rows: DataFrame, **dependents: tuple[DataFrame, list[str]]) -> dict[str, DataFrame]:
    """The fact table without ``ids`` and with no reference to them, and each dependent table without rows that name one."""
    gone = ids.select(F.col("id").alias("_gone"))
    kept = rows.join(gone, rows.id == F.col("_gone"), "left_anti")
    dangling = kept.join(gone, kept.superseded_by == F.col("_gone"), "left")
    out = {"facts": dangling.withColumn("superseded_by", F.when(F.col("_gone").isNull(), F.col("superseded_by"))).drop("_gone")}
    for name, (table, columns) in dependents.items():
        for c in columns:
            table = table.join(gone, table[c] == F.col("_gone"), "left_anti")
        out[name] = table
    return out


def supersede(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Facts after ``pairs`` (``old_id, new_id``): the old ones point to the new, with confidence 0 and state ``superseded``."""
    joined = rows.join(pairs, rows.id == pairs.old_id, "left")
    hit = F.col("old_id").isNotNull()
    return joined.withColumn("superseded_by", F.when(hit, F.col("new_id")).otherwise(F.col("superseded_by"))).withColumn("confidence", F.when(hit, F.lit(0.0)).otherwise(F.col("confidence"))).withColumn("state", F.when(hit, F.lit("superseded")).otherwise(F.col("state"))).drop("old_id", "new_id")

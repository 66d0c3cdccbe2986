"""Walks over hierarchies: ancestors by a frontier, chains by pointer jumping, and matches that open further matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.snapshots import dropped, stored

ANCESTOR_CAP = 5


def ancestors(asked: DataFrame, parents: DataFrame, cap: int = ANCESTOR_CAP) -> DataFrame:
    """(id, ancestor, distance): the `cap` nearest ancestors of each id of asked, ties to the smaller one.

    parents has (id, parent), several parents an id if need be.  The frontier goes up one level a round, and only what is new
    goes on, so a cycle ends by itself and an id is no ancestor of its own.  Each level that is not the last adds an ancestor,
    so `cap` rounds are enough.  Ids and parents that are null lead nowhere.
    """
    steps = parents.select("id", "parent").dropna().where("id <> parent").distinct()
    start = asked.select("id").dropna().distinct()
    found = frontier = stored(start.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")), "ancestors")
    for level in range(1, cap + 1):
        up = frontier.select("id", F.col("ancestor").alias("at")).join(steps.withColumnRenamed("id", "at"), "at")
        new = up.select("id", F.col("parent").alias("ancestor")).distinct().join(found.select("id", "ancestor"), ["id", "ancestor"], "left_anti")
        frontier = stored(new.withColumn("distance", F.lit(level)), "ancestors")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    nearest = Window.partitionBy("id").orderBy("distance", "ancestor")
    return found.where("distance > 0").withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= cap).drop("nth")


def cross_references(xrefs: Column) -> Column:
    """A map of the texts PREFIX:value of an array; of several with one prefix the first counts, others are no references."""
    parts = F.filter(F.coalesce(xrefs, F.array().cast("array<string>")), lambda x: x.rlike("(?s)^[^:]+:.+"))
    prefixes = F.transform(parts, lambda x: F.substring_index(x, ":", 1))
    first = F.filter(parts, lambda x, i: F.array_position(prefixes, F.substring_index(x, ":", 1)) == i + 1)
    value = lambda x: F.substring(x, F.instr(x, ":") + 1, F.length(x))
    return F.map_from_arrays(F.transform(first, lambda x: F.substring_index(x, ":", 1)), F.transform(first, value))


def related_classes(hits: DataFrame, parents: DataFrame, cap: int = ANCESTOR_CAP) -> DataFrame:
    """(asked, position, id, distance): each class that was hit for a key (asked, nth, id), in order of the hits, with its
    nearest ancestors behind it; a class counts where it comes first, positions start at 1."""
    up = ancestors(hits.select("id"), parents, cap)
    own = hits.select("asked", "nth", "id", F.lit(0).alias("distance"), F.col("id").alias("from"))
    above = hits.select("asked", "nth", F.col("id").alias("from")).join(up.withColumnRenamed("id", "from"), "from").select(
        "asked", "nth", F.col("ancestor").alias("id"), "distance", "from")
    first = own.unionByName(above).groupBy("asked", "id").agg(F.min(F.struct("nth", "distance", "id")).alias("at"))
    order = Window.partitionBy("asked").orderBy("at")
    return first.select("asked", F.row_number().over(order).alias("position"), "id", F.col("at.distance").alias("distance"))


def last_of_chains(merged: DataFrame) -> DataFrame:
    """(old, keeper): where each id of merged (old, keeper; one row an old id) ends up when keepers are merged in turn.

    Each round doubles how far a pointer jumps, so a chain of n merges takes log2(n) rounds; beside it goes the least id
    seen on the way, which is the keeper of a ring: ids that are merged in a circle go to the smallest of them, which then
    stays itself.  A merge into itself or into nothing is none.
    """
    step = merged.select("old", "keeper").dropna().where("old <> keeper")
    at = stored(step.select("old", F.col("keeper").alias("to"), F.least("old", "keeper").alias("least")), "chains")
    # every id that is merged away; a pointer that leaves them has arrived
    n, jump, written = at.count(), 1, [at]
    while jump <= n:
        ahead = at.select(F.col("old").alias("to"), F.col("to").alias("next"), F.col("least").alias("ahead"))
        new = at.join(ahead, "to", "left").select(
            "old", F.coalesce("next", "to").alias("to"), F.least("least", "ahead").alias("least"), F.col("next").isNotNull().alias("moved"))
        new = stored(new, "chains")
        going = not new.where("moved").isEmpty()
        dropped(*written)
        at, written, jump = new.drop("moved"), [new], 2 * jump
        if not going:
            break
    # what is still on the way is on a ring; the least id within n steps from a place of the ring is the ring's least
    ring = at.select(F.col("old").alias("to"), F.col("least").alias("of_ring"))
    return at.join(ring, "to", "left").select("old", F.coalesce("of_ring", "to").alias("keeper")).where("old <> keeper")


def families(members: DataFrame) -> DataFrame:
    """(parent, family): each parent of members (id, parent) with itself first and then its other members by id; an id
    without a parent is its own."""
    rows = members.select("id", F.coalesce("parent", "id").alias("parent")).dropna()
    others = F.array_sort(F.collect_set(F.when(F.col("id") != F.col("parent"), F.col("id"))))
    return rows.groupBy("parent").agg(others.alias("others")).select("parent", F.concat(F.array("parent"), "others").alias("family"))


def upgraded_index(candidates: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Match candidates to names while matches by name fill ids by which later candidates match.

    candidates: (nth, keys, name) in the order nth (unique); keys are ids as structs (kind, id), one of a kind at most, and
    name is the one that the candidate matches by name, or null.  known: (name, kind, id) that names bear already, at most one id of a kind each.
    A candidate with a key that is known by then matches by id (its first such key); else, by its name, if it has one, and
    then each of its keys whose kind the name lacks is known from then on.  Returns the matches (nth, matched, tier,
    kind; tier is `id`, `name` or `none`) and the index (kind, id, name, since), since null for what was known before.

    One after the other, that is a walk over all candidates.  But a candidate hangs only on earlier ones that may still fill
    one of its keys or of its name's kinds; so those are decided together that are first in all of them, and what is known
    then drops all that it settles.  The outcome is that of the walk; rounds are as many as the longest chain of such
    candidates.  A key or name with a large share of all rows is met by grouped minima, never by pairs.
    """
    rows = candidates.select("nth", F.explode("keys").alias("k"), "name").select("nth", "k.kind", "k.id", "name").dropna(subset=["kind", "id"]).distinct()
    index = stored(known.select("kind", "id", "name", F.lit(None).cast("long").alias("since")).dropna(subset=["kind", "id", "name"]).dropDuplicates(["kind", "id"]), "index")
    parts = [index]
    waiting = stored(rows.where("name IS NOT NULL").join(index.select("kind", "id"), ["kind", "id"], "left_anti"), "waiting")
    # a candidate with some key that is known from the start is settled
    hit = rows.join(index.select("kind", "id"), ["kind", "id"], "left_semi").select("nth").distinct()
    waiting = waiting.join(hit, "nth", "left_anti")
    borne = index.select("kind", "name", F.lit(True).alias("borne")).distinct()
    waiting = waiting.join(borne, ["kind", "name"], "left").withColumn("fills", F.col("borne").isNull()).drop("borne")
    waiting = stored(_with_hope(waiting), "waiting")
    while not waiting.where("fills").isEmpty():
        fills = F.when(F.col("fills"), F.col("nth"))
        by_key, by_kind = Window.partitionBy("kind", "id"), Window.partitionBy("kind", "name")
        # whether no earlier one may fill this key, nor, where this one would, this kind of its name
        free = F.coalesce(F.min(fills).over(by_key) >= F.col("nth"), F.lit(True)) & (~F.col("fills") | (F.min(fills).over(by_kind) >= F.col("nth")))
        seen = waiting.withColumn("free", free).withColumn("first", F.min("free").over(Window.partitionBy("nth")))
        new = stored(seen.where("first AND fills").select("kind", "id", "name", F.col("nth").alias("since")), "index")
        parts.append(new)
        # those that filled, and those that have by then a key that is filled, are settled
        gone = waiting.join(new.select("kind", "id", "since"), ["kind", "id"]).where("since <= nth").select("nth").distinct()
        left = waiting.join(gone, "nth", "left_anti")
        filled = new.select("kind", "name", F.lit(True).alias("now")).distinct()
        left = left.join(filled, ["kind", "name"], "left").withColumn("fills", F.col("fills") & F.col("now").isNull()).drop("now")
        before, waiting = waiting, stored(_with_hope(left), "waiting")
        dropped(before)
    index = reduce(DataFrame.unionByName, parts)
    found = candidates.select("nth", "name", F.posexplode_outer("keys").alias("place", "k")).select("nth", "name", "place", "k.kind", "k.id")
    met = found.join(index.withColumnRenamed("name", "by_id"), ["kind", "id"], "left").withColumn(
        "hit", F.when(F.col("by_id").isNotNull() & (F.col("since").isNull() | (F.col("since") < F.col("nth"))), F.struct("place", "by_id", "kind")))
    best = met.groupBy("nth").agg(F.min("hit").alias("hit"), F.first("name", ignorenulls=True).alias("name"))
    tier = F.when(F.col("hit").isNotNull(), "id").when(F.col("name").isNotNull(), "name").otherwise("none")
    return best.select("nth", F.coalesce("hit.by_id", "name").alias("matched"), tier.alias("tier"), F.col("hit.kind").alias("kind")), index


def _with_hope(waiting: DataFrame) -> DataFrame:
    """Without those that can fill nothing any more: they keep nobody waiting."""
    return waiting.join(waiting.where("fills").select("nth").distinct(), "nth", "left_semi")

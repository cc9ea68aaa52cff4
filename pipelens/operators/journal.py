"""Undoing a reorganisation: the moves of a journal folded into one move back for each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipelens.plans.lineage import cut

#: Doublings of the pointers: chains of up to 2 to this power moves.
MOST_DOUBLINGS = 60


def chained(moves: DataFrame) -> DataFrame:
    """``moves`` (seq, original, current) with ``previous``, the move that brought the file, and ``fate``.

    ``seq`` orders the journal and is different for every move. Of all that
    happens at one path the next event decides: a file that arrived is moved
    on, is overwritten by another arrival, or stays. Moves without a path on
    one side are left out, moves of a file onto itself do nothing.
    """
    real = moves.where("original IS NOT NULL AND current IS NOT NULL AND original <> current")
    event = lambda path, arrives: real.select(F.col(path).alias("path"), "seq", F.lit(arrives).alias("arrives"))
    at = Window.partitionBy("path").orderBy("seq")
    events = event("original", False).union(event("current", True)).select("*", F.lead("arrives").over(at).alias("then"), F.lag(F.when(F.col("arrives"), F.col("seq"))).over(at).alias("brought"))
    fate = F.when(F.col("then").isNull(), "stays").when(F.col("then"), "overwritten").otherwise("moved")
    after = events.where("arrives").select("seq", fate.alias("fate"))
    before = events.where("NOT arrives").select("seq", F.col("brought").alias("previous"))
    return real.join(after, "seq").join(before, "seq")


def folded(moves: DataFrame) -> DataFrame:
    """(seq, original, current, moves, fate): a row for each file of a journal, from where it was to where it stays or was overwritten.

    Pointers to the move before are doubled until all of them lead to the
    first move of a file: chains of n moves take log n rounds.
    """
    links = cut(chained(moves))
    hop = cut(links.select("seq", F.coalesce("previous", "seq").alias("first"), F.when(F.col("previous").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    for _ in range(MOST_DOUBLINGS):
        over = hop.select(F.col("seq").alias("first"), F.col("first").alias("beyond"), F.col("steps").alias("more"))
        hop = cut(hop.join(over, "first").select("seq", F.col("beyond").alias("first"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moving")))
        if hop.where("moving").isEmpty():
            break
        hop = hop.drop("moving")
    else:
        raise RuntimeError(f"chains of moves did not end after {MOST_DOUBLINGS} doublings")
    start = links.select(F.col("seq").alias("first"), F.col("original").alias("start"))
    ends = links.where("fate <> 'moved'").select("seq", "current", "fate")
    return ends.join(hop.select("seq", "first", "steps"), "seq").join(start, "first").select("seq", F.col("start").alias("original"), "current", (F.col("steps") + 1).alias("moves"), "fate")


def undo_plan(moves: DataFrame, files: DataFrame) -> DataFrame:
    """(seq, current, original, moves, status): for each moved file where it goes back to, and whether it can.

    ``moves`` may hold a ``digest`` of the file that was moved, ``files`` are
    the present (path, digest). Status is the first of: ``lost``, another file
    was moved over it; ``missing``, nothing is there any more; ``changed``, the
    digest is not that of the journal (null: not asked); ``taken``, another
    file that does not leave stands at the place or a later file also wants it;
    ``ok``. Files that are back already are left out. All moves that are ``ok``
    are to be made at once (through places of their own), as files may have
    changed places.
    """
    named = moves if "digest" in moves.columns else moves.withColumn("digest", F.lit(None).cast("string"))
    folds = folded(named.select("seq", "original", "current")).where("original <> current OR fate = 'overwritten'")
    own = named.select("seq", F.col("digest").alias("known"))
    present = files.where("path IS NOT NULL").groupBy("path").agg(F.max("digest").alias("digest"))
    here = present.select(F.col("path").alias("current"), F.col("digest").alias("now"), F.lit(True).alias("there"))
    ready = folds.join(own, "seq").join(here, "current", "left")
    first = F.when(F.col("fate") == "overwritten", "lost").when(F.col("there").isNull(), "missing").when(F.col("known") != F.col("now"), "changed")
    ready = cut(ready.select("seq", "current", "original", "moves", first.alias("why")))
    # a place is free if nothing stands there or what stands there leaves; what cannot leave keeps the next one from its place
    wanted = Window.partitionBy("original").orderBy("seq")
    going = ready.where("why IS NULL").withColumn("why", F.when(F.row_number().over(wanted) > 1, "taken"))
    stands = present.select(F.col("path").alias("original"))
    for _ in range(MOST_DOUBLINGS):
        leaves = going.where("why IS NULL").select(F.col("current").alias("original"))
        blocked = stands.join(leaves, "original", "left_anti").withColumn("blocked", F.lit(True))
        after = cut(going.join(blocked, "original", "left").select("seq", "current", "original", "moves", F.when(F.col("blocked"), F.lit("taken")).otherwise(F.col("why")).alias("why"), (F.col("why").isNull() & F.col("blocked").isNotNull()).alias("new")))
        done = after.where("new").isEmpty()
        going = after.drop("new")
        if done:
            break
    else:
        raise RuntimeError(f"files that hold each other's places in rows of more than {MOST_DOUBLINGS}")
    return ready.where("why IS NOT NULL").unionByName(going).select("seq", "current", "original", "moves", F.coalesce("why", F.lit("ok")).alias("status"))


def undone(files: DataFrame, plan: DataFrame) -> DataFrame:
    """``files`` after all moves of a plan that are ``ok``; other columns are kept."""
    back = plan.where("status = 'ok'").select(F.col("current").alias("path"), F.col("original").alias("_back"))
    return files.join(back, "path", "left").withColumn("path", F.coalesce("_back", "path")).select(*files.columns)

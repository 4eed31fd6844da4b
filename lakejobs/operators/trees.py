"""Trees of jobs of any depth: root, depth and size, in as many rounds as the depth has binary digits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.session import ensure_checkpoints
from lakejobs.sources.spec import quote_name

HOT_JUMPS = 100_000  # jobs that point at one ancestor, of which there are at most all jobs over so many


def job_roots(jobs: DataFrame, id: str = "id", parent: str = "parent") -> DataFrame:
    """(id, root, depth, size) of every job, from (id, parent) rows.

    A root has no parent, or one that is not in the table; its depth is 0. ``size`` is the number of jobs at and below a
    job. A job whose parents lead into a circle has none of the three. Of rows with equal ids the smallest parent
    counts; null ids are left out.

    Pointers are doubled: after round k every job knows its ancestor 2**k levels up, how far it has looked, and the jobs less
    than 2**k levels below it. Jobs that have reached their root are done. A round that finishes none leaves only circles,
    since above a deeper job there is one of every depth. Sums over the jobs below one ancestor are added up per
    task before the shuffle, and ancestors of more than :data:`HOT_JUMPS` jobs are sent to these instead of joined by a shuffle.
    """
    ensure_checkpoints(jobs.sparkSession)
    pairs = jobs.select(F.col(quote_name(id)).alias("id"), F.col(quote_name(parent)).alias("parent")).where("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))
    known = pairs.select(F.col("id").alias("_known"))
    found = pairs.join(known, F.col("parent") == F.col("_known"), "left")
    state = found.select(
        "id", F.col("_known").alias("jump"), F.coalesce("_known", "id").alias("root"), F.col("_known").isNotNull().cast("bigint").alias("depth"), F.lit(1).cast("bigint").alias("size")
    ).checkpoint()
    open_ = state.where("jump is not null").count()
    while open_:
        state = _doubled(state).checkpoint()
        left = state.where("jump is not null").count()
        if left == open_:
            break
        open_ = left
    whole = F.col("jump").isNull()
    return state.select(F.col("id").alias(id), *[F.when(whole, F.col(c)).alias(c) for c in ("root", "depth", "size")])


def _doubled(state: DataFrame) -> DataFrame:
    sums = state.where("jump is not null").groupBy("jump").agg(F.sum("size").alias("_more"), F.count("*").alias("_jumps"))
    below = sums.withColumnRenamed("jump", "_at").checkpoint()
    grown = state.join(below.drop("_jumps"), F.col("id") == F.col("_at"), "left")
    ahead = state.select(F.col("id").alias("_to"), F.col("jump").alias("_jump"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
    size = (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size")
    # Done jobs stay out of the join: most of them point at few roots.
    done = grown.where("jump is null").select("id", "jump", "root", "depth", size)
    moving = grown.where("jump is not null")
    # Nor do many jobs above one circle or ancestor meet in one task: such ancestors are few and go to the jobs.
    hot = F.broadcast(below.where(F.col("_jumps") > HOT_JUMPS).select(F.col("_at").alias("_hot")))
    to_hot = moving.join(F.broadcast(ahead.join(hot, F.col("_to") == F.col("_hot"), "left_semi")), F.col("jump") == F.col("_to"))
    to_rest = moving.join(hot, F.col("jump") == F.col("_hot"), "left_anti").join(ahead, F.col("jump") == F.col("_to"))
    moved = to_hot.unionByName(to_rest)
    return done.unionByName(moved.select("id", F.col("_jump").alias("jump"), F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), size))

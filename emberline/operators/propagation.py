"""Risk propagation by semi-naive supersteps with dominance pruning.

Once a message has left its first user, what becomes of it depends on its value, its time and the
static tables alone, and a larger value or an earlier time can only help it. So a message at a user is
of no use if a message from the same neighbour, or messages from two different neighbours, came with
no smaller value and no later time: for every neighbour it could go on to, one of the others goes
there too. What is left for each user is a small set, however many messages arrive. Each superstep
follows messages over the contacts of two blocks of users in one task, which drops those of no use, and
one exchange by block of receivers drops the rest. A message that the receiver can't send on and that
raises no exposure goes too. Exposures are those of all valid walks.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.expr import score_weight
from emberline.lineage import cut, spread
from emberline.operators import blocks
from emberline.params import SEC_PER_DAY, PropagationParams
from emberline.schema import CONTACTS, SCORES, check_columns


def initial_scores(scores: DataFrame) -> DataFrame:
    """(user, init_val, init_time): each user's largest score, of equal ones the latest."""
    top = F.max(F.struct("val", "time")).alias("top")
    return scores.groupBy("user").agg(top).select("user", F.col("top.val").alias("init_val"), F.col("top.time").alias("init_time"))


def eligible_scores(scores: DataFrame, edges: DataFrame, p: PropagationParams) -> DataFrame:
    """(src, dest, ctime, val, time): scores that may have been passed on at each contact."""
    joined = scores.withColumnRenamed("user", "src").join(edges, "src")
    return joined.where(F.col("time") <= F.col("ctime") + p.time_buffer).select("src", "dest", "ctime", "val", "time")


def eligible_summary(scores: DataFrame, edges: DataFrame, p: PropagationParams) -> DataFrame:
    """(src, dest, n, top, latest): of each edge's eligible scores how many there are, the largest value and the latest time, edges with
    none aside. Scores and edges of a user are put in one order of time, so no score is joined with each edge."""
    none = F.lit(None)
    rows = scores.where("user is not null and time is not null").select(F.col("user").alias("src"), F.col("time").alias("at"), F.lit(1).alias("score"), none.cast("long").alias("dest"), "val").unionByName(
        edges.where("src is not null and ctime is not null").select("src", (F.col("ctime") + p.time_buffer).alias("at"), none.cast("int").alias("score"), "dest", none.cast("double").alias("val"))
    )
    before = Window.partitionBy("src").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    told = spread(rows, "src").select("src", "dest", "score", F.count("score").over(before).alias("n"), F.max("val").over(before).alias("top"), F.max(F.when(F.col("score") == 1, F.col("at"))).over(before).alias("latest"))
    return told.where("score is null and n > 0").drop("score")


def best_scores(scores: DataFrame, edges: DataFrame, p: PropagationParams) -> DataFrame:
    """(src, dest, ctime, val, time): the eligible score with the largest weight; ties go to the larger value, then
    the earlier time.

    Scores and edges of a user are put in one order of time. Before a contact the order of weights
    doesn't depend on it, so a running maximum serves; from it to the end of the buffer the weight is
    the value alone, for which a range frame serves. No score is joined with each edge."""
    log_val = F.log(F.greatest(F.col("val"), F.lit(p.eps)))
    none = F.lit(None)
    rows = scores.select(F.col("user").alias("src"), F.col("time").alias("at"), F.lit(0).alias("kind"), none.cast("long").alias("dest"), "val").unionByName(
        edges.select("src", F.col("ctime").alias("at"), F.lit(1).alias("kind"), "dest", none.cast("double").alias("val"))
    )
    is_score = F.col("kind") == 0
    older = F.when(is_score, F.struct((log_val + F.col("at") / F.lit(SEC_PER_DAY * float(p.time_const))).alias("w"), F.col("val"), (-F.col("at")).alias("t")))
    later = F.when(is_score, F.struct(F.col("val").alias("w"), F.col("val"), (-F.col("at")).alias("t")))
    by_user = Window.partitionBy("src").orderBy("at")
    past, buffer = by_user.rangeBetween(Window.unboundedPreceding, 0), by_user.rangeBetween(1, p.time_buffer)
    found = spread(rows, "src").withColumn("past", F.max(older).over(past)).withColumn("later", F.max(later).over(buffer)).where("kind = 1")

    def ranked(side: str):
        val, at = F.col(f"{side}.val"), -F.col(f"{side}.t")
        return F.when(F.col(side).isNotNull(), F.struct(score_weight(val, at, "at", p.time_const, p.eps).alias("w"), val.alias("val"), F.col(f"{side}.t").alias("t")))

    best = F.greatest(F.coalesce(ranked("past"), ranked("later")), F.coalesce(ranked("later"), ranked("past")))
    return found.withColumn("best", best).where("best is not null").select("src", "dest", F.col("at").alias("ctime"), F.col("best.val").alias("val"), (-F.col("best.t")).alias("time"))


def limits(scores: DataFrame, edges: DataFrame, p: PropagationParams) -> DataFrame:
    """Edges with their sender's limits: the least value it sends, and the latest time."""
    senders = initial_scores(scores).select(F.col("user").alias("src"), (F.col("init_val") * p.transmission * p.tol).alias("least"), F.col("init_time").alias("latest"))
    return edges.join(senders, "src")


def first_hop(scores: DataFrame, edges: DataFrame, p: PropagationParams) -> DataFrame:
    """(src, dest, val, time): the first message over each edge, already attenuated."""
    senders = limits(scores, edges, p).select("src", "least", "latest").distinct()
    sent = best_scores(scores, edges, p).withColumn("val", F.col("val") * p.transmission).join(senders, "src")
    return sent.where("val >= least and time <= latest").select("src", "dest", "val", "time")


def forward(frontier: DataFrame, edges: DataFrame, p: PropagationParams) -> DataFrame:
    """One superstep without history: frontier (src, dest, val, time) and edges with limits -> the next messages, the
    largest value for each edge and time."""
    f = frontier.select(F.col("src").alias("came_from"), F.col("dest").alias("src"), F.col("val").alias("v"), "time")
    moved = f.join(edges, "src").where("dest <> came_from").where(F.col("time") <= F.col("ctime") + p.time_buffer)
    moved = moved.withColumn("val", F.col("v") * p.transmission).where("val >= least and time <= latest")
    return moved.groupBy("src", "dest", "time").agg(F.max("val").alias("val")).select("src", "dest", "val", "time")


def undominated(messages: DataFrame, contacts: blocks.Contacts) -> DataFrame:
    """messages (src, dest, val, time, round) without those that others at the same user make useless; see blocks.settled()."""
    rows = spread(messages.withColumn("block", contacts.block_of("dest")), "block")
    return rows.groupBy("block").applyInArrow(lambda t: blocks.settled(t), "src long, dest long, val double, time long, round int, sends boolean, only long")


def first_messages(scores: DataFrame, contacts: blocks.Contacts, p: PropagationParams) -> DataFrame:
    """(user, at, val, time, sends): what a user passes on over contacts at a time, already attenuated, and whether it is sent. It depends on
    the user and the time alone, so there is a row for each two of these and none for a contact."""
    best = best_scores(scores, contacts.met.select(F.col("user").alias("src"), F.lit(0).cast("long").alias("dest"), F.col("time").alias("ctime")), p)
    sent = best.select(F.col("src").alias("user"), F.col("ctime").alias("at"), (F.col("val") * p.transmission).alias("val"), "time").join(receivers(scores, p), "user")
    return sent.select("user", "at", "val", "time", ((F.col("val") >= F.col("least")) & (F.col("time") <= F.col("latest"))).alias("sends"))


def receivers(scores: DataFrame, p: PropagationParams) -> DataFrame:
    """(user, least, latest, best): limits of what each user sends, and its own largest score."""
    known = initial_scores(scores).where("user is not null and init_val is not null and init_time is not null")
    return known.select(F.col("user").cast("long").alias("user"), (F.col("init_val") * p.transmission * p.tol).alias("least"), F.col("init_time").cast("long").alias("latest"), F.col("init_val").alias("best"))


def first_over(scores: DataFrame, contacts: blocks.Contacts, p: PropagationParams) -> DataFrame:
    """first_hop() by blocks of users."""
    none = F.lit(None).cast("long")
    sent = first_messages(scores, contacts, p).where("sends").select("user", "at", "val", "time", none.alias("came"), none.alias("only"))
    everyone = receivers(scores, p)
    return contacts.tasks(blocks.packed(everyone, sent, contacts), lambda pairs, rows, low, high: blocks.first_over(pairs, rows, low, high), "src long, dest long, val double, time long")


def second_messages(scores: DataFrame, contacts: blocks.Contacts, p: PropagationParams) -> DataFrame:
    """(user, at, val, time, came, only): what users send on of first messages, already attenuated. Of those that came to a user at one time
    every neighbour gets the largest that it did not send itself, so two rows serve however many came; at is null."""
    none = F.lit(None).cast("long")
    sent = first_messages(scores, contacts, p).where("sends").select("user", "at", "val", "time", none.alias("came"), none.alias("only"))
    transmission = p.transmission
    found = contacts.tasks(blocks.packed(receivers(scores, p), sent, contacts), lambda pairs, rows, low, high: blocks.heads(pairs, rows, low, high, transmission), "src long, dest long, val double, time long")
    rows = spread(found.withColumn("block", contacts.block_of("dest")), "block")
    going = rows.groupBy("block").applyInArrow(lambda t: blocks.sent_on(t, transmission), "user long, val double, time long, came long, only long")
    return going.select("user", none.alias("at"), "val", "time", "came", "only")


def forward_over(messages: DataFrame, scores: DataFrame, contacts: blocks.Contacts, p: PropagationParams) -> DataFrame:
    """forward() by blocks of users, of second_messages()."""
    buffer = p.time_buffer
    return contacts.flows(blocks.packed(receivers(scores, p), messages, contacts), lambda pairs, rows, low, high: blocks.delivered(pairs, rows, low, high, buffer), "src long, dest long, val double, time long")


def counted(scores: DataFrame, contacts: blocks.Contacts, p: PropagationParams) -> DataFrame:
    """(src, considered, sent): over how many contacts a user has a score to pass on, and over how many it sends one."""
    none = F.lit(None).cast("long")
    every = first_messages(scores, contacts, p).select("user", "at", F.lit(0.0).alias("val"), F.coalesce(F.col("sends").cast("long"), F.lit(0).cast("long")).alias("time"), none.alias("came"), none.alias("only"))
    found = contacts.tasks(blocks.packed(receivers(scores, p), every, contacts), lambda pairs, rows, low, high: blocks.counted(pairs, rows, low, high), "src long, considered long, sent long")
    return found.groupBy("src").agg(F.sum("considered").alias("considered"), F.sum("sent").alias("sent"))


@dataclass
class Propagated:
    """exposures (user, init_val, exposure), a log of one row, and updates (user, updates): in how many supersteps the
    user's exposure rose, of users with a score."""

    exposures: DataFrame
    log: DataFrame
    updates: DataFrame


def update_counts(scores: DataFrame, arrivals: list[DataFrame]) -> DataFrame:
    """(user, updates) from the largest value (dest, round, val) that came to each user in each superstep."""
    first = initial_scores(scores).select("user", F.lit(0).alias("round"), F.col("init_val").alias("val"))
    came = first
    for a in arrivals:
        came = came.unionByName(a.select(F.col("dest").alias("user"), "round", "val"))
    before = Window.partitionBy("user").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    rose = came.withColumn("rose", (F.col("val") > F.max("val").over(before)).cast("long"))
    return rose.groupBy("user").agg(F.coalesce(F.sum("rose"), F.lit(0)).alias("updates"), F.min("round").alias("least")).where("least = 0").drop("least")


def propagate(scores: DataFrame, contacts: DataFrame | blocks.Contacts, p: PropagationParams | None = None, validate: bool = True) -> Propagated:
    """Exposures (user, init_val, exposure) and a log of one row. Empty scores or contacts give an empty result."""
    p = p or PropagationParams()
    check_columns(scores, SCORES, "scores")
    if isinstance(contacts, DataFrame):
        check_columns(contacts, CONTACTS, "contacts")
    spark = scores.sparkSession
    began = time.time()
    scores = scores.select("user", "val", "time")
    contacts = contacts if isinstance(contacts, blocks.Contacts) else blocks.of_contacts(contacts)
    if scores.isEmpty() or contacts.rows.isEmpty():
        empty, none = spark.createDataFrame([], "user long, init_val double, exposure double"), spark.createDataFrame([], "user long, updates long")
        return Propagated(empty, _log(spark, empty, none, p, began, 0, 0, "EMPTY"), none)
    if validate:
        contacts.check_users(scores)
    limited = cut(receivers(scores, p))
    none = F.lit(None).cast("long")
    sent = first_messages(scores, contacts, p).where("sends").select("user", "at", "val", "time", none.alias("came"), none.alias("only"))
    transmission, buffer = p.transmission, p.time_buffer
    schema = "src long, dest long, val double, time long"
    new = contacts.tasks(blocks.packed(limited, sent, contacts), lambda pairs, rows, low, high: blocks.followed(pairs, rows, low, high, transmission, None), schema)
    state = cut(undominated(new.withColumn("round", F.lit(1)), contacts))
    messages, rounds, stale, stop = state.count(), 1, 0, "CONVERGED"
    best, arrivals = None, []
    while True:
        frontier = state.where(F.col("round") == rounds)
        arrivals.append(frontier.groupBy("dest", "round").agg(F.max("val").alias("val")))
        if p.max_rounds is not None and rounds >= p.max_rounds:
            stop = "MAX_ROUNDS"
            break
        if p.max_dur is not None and time.time() - began >= p.max_dur:
            stop = "MAX_DURATION"
            break
        if p.early_stop is not None:
            total = state.groupBy("dest").agg(F.max("val").alias("v")).agg(F.sum("v")).first()[0]
            stale = stale + messages if total == best else 0
            best = total
            if stale >= p.early_stop:
                stop = "EARLY_STOP"
                break
        got = state.groupBy(F.col("dest").alias("user")).agg(F.max("val").alias("got"))
        now = limited.join(got, "user", "left").select("user", "least", "latest", F.greatest("best", F.coalesce("got", "best")).alias("best"))
        going = frontier.where("sends").select(F.col("dest").alias("user"), none.alias("at"), (F.col("val") * p.transmission).alias("val"), "time", F.col("src").alias("came"), "only")
        going = going.join(limited, "user").where("val >= least and time <= latest").select("user", "at", "val", "time", "came", "only")
        new = contacts.tasks(blocks.packed(now, going, contacts), lambda pairs, rows, low, high: blocks.followed(pairs, rows, low, high, transmission, buffer), schema)
        state = cut(undominated(state.drop("sends", "only").unionByName(new.withColumn("round", F.lit(rounds + 1))), contacts))
        rounds += 1
        arrived = state.where(F.col("round") == rounds).count()
        if not arrived:
            break
        messages += arrived
    received = state.groupBy(F.col("dest").alias("user")).agg(F.max("val").alias("received"), F.count(F.lit(1)).alias("kept"))
    exposures = initial_scores(scores).join(received, "user", "left").select("user", "init_val", F.greatest("init_val", F.coalesce("received", F.lit(0.0))).alias("exposure"))
    exposures, updates = cut(exposures), cut(update_counts(scores, arrivals))
    return Propagated(exposures, _log(spark, exposures, updates, p, began, rounds, messages, stop, contacts), updates)


def exposures(scores: DataFrame, contacts: DataFrame | blocks.Contacts, p: PropagationParams | None = None, validate: bool = True) -> DataFrame:
    return propagate(scores, contacts, p, validate).exposures


def update_stats(exposed: DataFrame) -> DataFrame:
    """nodes, updates, and min, max, mean and population deviation of the rise of users whose score rose; 0 if none."""
    rise = F.when(F.col("exposure") > F.col("init_val"), F.col("exposure") - F.col("init_val"))
    stats = [F.coalesce(f(rise), F.lit(0.0)).alias(n) for f, n in ((F.min, "min_update"), (F.max, "max_update"), (F.avg, "avg_update"), (F.stddev_pop, "std_update"))]
    return exposed.agg(F.count(F.lit(1)).alias("nodes"), F.count(rise).alias("updates"), *stats)


def weighted_summary(workers: DataFrame) -> DataFrame:
    """Statistics of workers to one row: means weighted by updates, 0 where there are none."""
    updates = F.sum("updates")

    def mean(c: str):
        return F.when(updates == 0, F.lit(0.0)).otherwise(F.sum(F.col(c) * F.col("updates")) / F.nullif(updates, F.lit(0)))

    return workers.agg(
        F.max("runtime").alias("runtime"), F.sum("messages").alias("messages"), F.sum("nodes").alias("nodes"), updates.alias("updates"),
        F.min("min_update").alias("min_update"), F.max("max_update").alias("max_update"), mean("avg_update").alias("avg_update"),
    )


def _log(spark, exposed: DataFrame, counts: DataFrame, p: PropagationParams, began: float, rounds: int, messages: int, stop: str, contacts: blocks.Contacts | None = None) -> DataFrame:
    """One row of Statistics and Parameters structs."""
    size = contacts.size() if contacts is not None else spark.createDataFrame([(0,)], "edge_count long")
    some = F.when(F.col("updates") > 0, F.col("updates"))
    often = counts.agg(*[F.coalesce(f(some).cast("double"), F.lit(0.0)).alias(n) for f, n in ((F.min, "min_updates"), (F.max, "max_updates"), (F.avg, "avg_updates"), (F.stddev_pop, "std_updates"))])
    stats = update_stats(exposed).crossJoin(F.broadcast(often)).crossJoin(F.broadcast(size)).select(  # one row each
        F.struct(
            F.lit(round(time.time() - began, 4)).alias("RuntimeInSeconds"), F.lit(messages).cast("long").alias("Messages"), F.col("nodes").alias("Nodes"), F.col("edge_count").alias("Edges"),
            F.lit(rounds).alias("Rounds"), F.col("updates").alias("Updates"), F.bround("min_update", 4).alias("MinUpdate"), F.bround("max_update", 4).alias("MaxUpdate"),
            F.bround("avg_update", 4).alias("AvgUpdate"), F.bround("std_update", 4).alias("StdUpdate"),
            F.col("min_updates").alias("MinUpdates"), F.col("max_updates").alias("MaxUpdates"), F.bround("avg_updates", 4).alias("AvgUpdates"), F.bround("std_updates", 4).alias("StdUpdates"), F.lit(stop).alias("StopCondition"),
            (F.lit(messages) + F.col("nodes")).alias("MessagesCompat"),
        ).alias("Statistics"),
        F.struct(
            F.lit(float(p.time_buffer)).alias("TimeBufferInSeconds"), F.lit(float(p.time_const)).alias("TimeConstant"), F.lit(p.transmission).alias("Transmission"), F.lit(p.eps).alias("ZeroApproximation"),
            F.lit(p.tol).alias("SendTolerance"), F.lit(p.max_rounds).cast("int").alias("MaxRounds"), F.lit(p.max_dur).cast("double").alias("MaxDurationInSeconds"), F.lit(p.early_stop).cast("long").alias("EarlyStop"),
        ).alias("Parameters"),
    )
    return stats

"""Life of a message in the work queue: states folded from an append-only log of events.

Events are rows (id, seq, event, error); ``seq`` orders the events of an id. Fixed values: events are
``preso`` (claimed), ``classificato``, ``archiviato``, ``fallito`` and ``riprova``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The states and how often a message may be tried.
NEW, IN_PROGRESS, CLASSIFIED, ARCHIVED, SUSPENDED = "nuovo", "in_corso", "classificato", "archiviato", "sospeso"
ATTEMPTS = 3


def fold(events: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """(id, state, attempts, last_error): the present state of each message.

    Claims are counted since the last retry; a failure suspends when they are used up, else the message is
    new again. Two combinable aggregates: an id with many events gathers counts and not its rows.
    """
    retried = events.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("event") == "riprova", F.col("seq"))), F.lit(-1)).alias("_since"))
    live = events.join(retried, "id")
    fresh = F.col("seq") > F.col("_since")
    out = live.groupBy("id").agg(
        F.count_if(fresh & (F.col("event") == "preso")).alias("attempts"), F.max_by("event", "seq").alias("_last"), F.max_by(F.when(F.col("event") == "fallito", F.substring("error", 1, 500)), "seq").alias("last_error"),
    )
    state = (
        F.when(F.col("_last") == "preso", IN_PROGRESS).when(F.col("_last") == "classificato", CLASSIFIED).when(F.col("_last") == "archiviato", ARCHIVED)
        .when((F.col("_last") == "fallito") & (F.col("attempts") >= attempts), SUSPENDED).otherwise(NEW)
    )
    return out.select("id", state.alias("state"), F.col("attempts").cast("int").alias("attempts"), "last_error")


def claim(state: Column, attempts: Column, most: int = ATTEMPTS) -> Column:
    """STRUCT granted, reason: whether a message may be taken up; one that nobody knows may."""
    used = F.coalesce(attempts, F.lit(0))
    reason = (
        F.when(state == ARCHIVED, "già lavorato").when(state == CLASSIFIED, "già classificato").when(state == SUSPENDED, "sospeso dopo troppi tentativi").when(used >= most, "tentativi esauriti").otherwise("")
    )
    return F.struct((reason == "").alias("granted"), reason.alias("reason"))


def unworked(queue: DataFrame, judged: DataFrame, states: DataFrame, default: str = "ancora in coda, non classificato") -> DataFrame:
    """Queue items without an outcome, and why: the error of a suspended one, else the default."""
    why = states.where(F.col("state") == SUSPENDED).select("id", F.coalesce("last_error", F.lit("sospeso")).alias("_why"))
    left = queue.join(judged.select("id").distinct(), "id", "left_anti").join(why, "id", "left")
    return left.withColumn("reason", F.coalesce("_why", F.lit(default))).drop("_why")


def to_move(states: DataFrame, queue: DataFrame) -> DataFrame:
    """Classified messages and what is left to do: ``sposta`` where the item still lies in the queue, else ``archivia``."""
    here = queue.select("id").distinct().withColumn("_here", F.lit(True))
    left = states.where(F.col("state") == CLASSIFIED).join(here, "id", "left")
    return left.select("id", F.when(F.col("_here"), "sposta").otherwise("archivia").alias("todo"))


def moved(queue: DataFrame, done: DataFrame, day: Column) -> DataFrame:
    """Work table rows of the done items under their day; an item that was moved before is not moved again."""
    return queue.join(done.select("id").distinct(), "id", "left_semi").withColumn("giorno", day).dropDuplicates(["id"])


def triage_budget(queue: DataFrame, limit: int = 200, at: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(taken, untouched): the oldest ``limit`` items and the rest."""
    taken = queue.orderBy(F.col(at).isNull(), at, "id").limit(limit)
    return taken, queue.join(taken.select("id"), "id", "left_anti")


def states_report(states: DataFrame) -> DataFrame:
    """(dimension, value, n): messages by state, by class where one is set, and in all."""
    sets = states.groupingSets([[F.col("state")], [F.col("class")], []], F.col("state"), F.col("class")).agg(F.count(F.lit(1)).alias("n"), F.grouping("state").alias("_s"), F.grouping("class").alias("_c"))
    named = sets.select(F.when(F.col("_s") == 0, "stato").when(F.col("_c") == 0, "classe").otherwise("totale").alias("dimension"), F.coalesce("state", "class", F.lit("")).alias("value"), "n")
    return named.where((F.col("dimension") == "totale") | (F.col("value") != ""))


class Breaker:
    """Stops a run after several failures in a row: that is no accident but a breakdown."""

    def __init__(self, most: int = 5):
        self.most, self.row = most, 0

    def seen(self, ok: bool) -> bool:
        """Count one result; whether the run may go on."""
        self.row = 0 if ok else self.row + 1
        return self.row < self.most

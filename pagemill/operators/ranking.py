"""Access counts, rankings and sessions over the access log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.constants import HOT_TOP_N, RECENT_PER_USER, SESSION_IDLE_MINUTES
from pagemill.operators.segments import by_second, run_numbers


def hot_counts(access_log: DataFrame) -> DataFrame:
    """Accesses per document."""
    return access_log.groupBy("doc_id").agg(F.count("*").alias("score"))


def hot_top_n(counts: DataFrame, n: int = HOT_TOP_N) -> DataFrame:
    """The ``n`` highest scores; ties list the higher id first."""
    return counts.orderBy(F.col("score").desc(), F.col("doc_id").desc()).limit(n)


def hot_remove(counts: DataFrame, deleted: DataFrame) -> DataFrame:
    return counts.join(deleted.select("doc_id"), "doc_id", "left_anti")


def recent_access(access_log: DataFrame, n: int = RECENT_PER_USER) -> DataFrame:
    """The last ``n`` distinct documents of each user, newest first.

    Repeated visits shrink before the shuffle, and a rank filter of this form is
    applied in every partition first, so a busy user sends few rows.
    """
    visits = access_log.groupBy("user_id", "doc_id").agg(F.max("ts").alias("last_ts"))
    newest = Window.partitionBy("user_id").orderBy(F.col("last_ts").desc(), F.col("doc_id").desc())
    return visits.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n)


def sessions(access_log: DataFrame, idle_minutes: int = SESSION_IDLE_MINUTES) -> DataFrame:
    """Visits of a user with no gap of ``idle_minutes`` or more between them.

    The log is scanned in segments of time, so one busy user is many tasks.
    """
    idle = F.expr(f"INTERVAL {int(idle_minutes)} MINUTES")
    numbered = run_numbers(
        access_log,
        ["user_id"],
        ["ts", "event_id"],
        by_second("ts"),
        ["ts"],
        lambda previous, current: current["ts"] - previous["ts"] >= idle,
        "session_no",
    )
    return numbered.groupBy("user_id", "session_no").agg(
        F.min("ts").alias("session_start"),
        F.max("ts").alias("last_access"),
        F.count("*").alias("accesses"),
    )

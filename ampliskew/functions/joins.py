"""Joins of data rows with facts about their sample, pair or stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep

#: Facts up to which they are broadcast (a few numbers and a key each), and rows of one key that a task may get beyond it.
FACTS, TASK_ROWS = 100_000, 1_000_000


def join_facts(rows: DataFrame, facts: DataFrame, on, spread, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``facts`` on ``on``, without bringing all rows of one key to one task.

    Facts are stored once and counted; up to FACTS of them are broadcast and no data row moves. More are copied to as
    many salts as the largest key of ``rows`` has TASK_ROWS, and rows are dealt by ``on`` and a hash of ``spread`` (the
    columns that tell the rows of a key apart).
    """
    on, spread = [on] if isinstance(on, str) else list(on), [spread] if isinstance(spread, str) else list(spread)
    facts = keep(facts)
    if facts.limit(FACTS + 1).count() <= FACTS:
        return rows.join(F.broadcast(facts), on, how)
    most = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    salts = -(-most // TASK_ROWS)
    if salts <= 1:
        return rows.join(facts, on, how)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copied = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied, [*on, "_salt"], how).drop("_salt")

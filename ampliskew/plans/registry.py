"""Named queries and, where SQL can express them, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cols import rnd
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = (), r: str = "", i: str = "", digits: int = 6, nudge: float = 0.0):
    """Registers ``fn(tables)``.

    ``needs`` names the derived tables the SQL reads; columns in ``r`` are rounded on both sides (sums of doubles
    depend on their order), columns in ``i`` are cast to BIGINT on both sides. ``nudge`` is added on both sides before
    rounding where exact halves are common, since their last bit decides the direction.
    """
    rc, ic = r.split(), i.split()

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark, sf_dir):
            df = fn(fx.Tables(spark, sf_dir))
            return df.withColumns({**{x: rnd(F.col(x) + nudge if nudge else x, digits) for x in rc}, **{x: F.col(x).cast("long") for x in ic}})

        QUERIES[name] = run
        if sql:
            body = fx.with_tables(needs, sql)
            if rc or ic:
                rep = [f'round({x}{f" + {nudge:.12f}" if nudge else ""}, {digits}) + 0.0 AS {x}' for x in rc] + [f'CAST({x} AS BIGINT) AS {x}' for x in ic]
                body = f"SELECT * REPLACE ({', '.join(rep)}) FROM ({body}) q"
            ORACLES[name] = body
        return fn

    return wrap

"""Recursive CTEs with UNION: a fixed point over snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import DialectError
from ..storage import snapshot

#: Rows that a recursion may make (fixed value of the dialect).
MOST_ROWS = 10_000
#: Rounds after which what was found is written as one, so that plans stay small.
ROUNDS = 16


def fixed_point(spark: SparkSession, view: str, start: str, again: str, most: int = MOST_ROWS) -> None:
    """Register ``view`` as all rows that ``again`` reaches from ``start``. Each
    round sees the rows that the last one added; null equals null. The rounds
    are written to the shared folder, so the lineage doesn't grow."""
    delta = snapshot(spark.sql(start).distinct(), "recursion")
    whole, size, rounds = delta, delta.count(), 0
    while True:
        if size > most:
            raise DialectError(f"a recursion of more than {most} rows")
        name = f"{view}_{uuid.uuid4().hex[:8]}"
        delta.createOrReplaceTempView(view)
        found = spark.sql(again).distinct()
        cond = [found[c].eqNullSafe(whole[c]) for c in whole.columns]
        delta = snapshot(found.join(whole, cond, "left_anti"), name)
        more = delta.count()
        if not more:
            break
        size, rounds = size + more, rounds + 1
        whole = whole.unionAll(delta)
        if not rounds % ROUNDS:
            whole = snapshot(whole, "recursion")
    whole.select([F.col(c) for c in whole.columns]).createOrReplaceTempView(view)

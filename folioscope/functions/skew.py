"""Join many rows to one row per key when a key may hold a large share of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut_lineage


def hot_join(big: DataFrame, small: DataFrame, keys: list[str], n_rows: str, how: str = "inner") -> DataFrame:
    """``big`` with the columns of its key's row in ``small``; NULL keys meet.

    ``small`` is unique on ``keys``; its row count ``n_rows`` is not carried.
    Adaptive execution splits the tasks of a hot key only if neither side is an
    aggregation in the same job, so ``small`` is checkpointed first and is a
    plain input of an ordinary join. The join is the same at every size.
    """
    values = [c for c in small.columns if c not in (*keys, n_rows)]
    one = cut_lineage(small.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], *values))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    return big.join(one, same, how).select(*big.columns, *values)


def grown(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled at every size, never sent whole to every task.

    Spark guesses a table's size from the files it was made of. Rows that are
    exploded, and texts made in the job, are many times that, so what looks small
    enough to broadcast may not fit the driver.
    """
    return df.hint("merge")

"""Salting, which spreads the rows of one hot key over many tasks, and broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: So many salts at least; a cluster with more shuffle partitions gets as many salts as it has of them.
MIN_SALTS = 16


def salts(df: DataFrame) -> int:
    """Tasks that the rows of a single key may be spread over: as many as a shuffle has."""
    return max(MIN_SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def salt(n: int, *by: Column | str) -> Column:
    """A number below ``n`` told by ``by``: equal values get equal salts, also when a task runs again.

    Spread by what is counted (the document, say), so that the sets of different salts are disjoint and
    their distinct counts add up.
    """
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")


def totals(partial: DataFrame, keys: list[str], **sums: str) -> DataFrame:
    """The salted sums of ``partial`` (``keys``, ``salt``, ...) replaced by their totals per key, one row for each salt that occurs.

    A key has as many rows here as salts at most, so no window is larger; joined back by key and salt, a hot key
    stays spread.
    """
    over = Window.partitionBy(*keys)
    return partial.select(*keys, "salt", *[F.sum(c).over(over).alias(name) for name, c in sums.items()])


#: Rows of a few numbers each that may be broadcast: some ten megabytes.
MAX_BROADCAST = 500_000


def checked(df: DataFrame, limit: int = MAX_BROADCAST) -> DataFrame:
    """``df``, of a few narrow columns, worked out and checkpointed: to be broadcast if it has ``limit`` rows at most, else joined by shuffle."""
    made = df.checkpoint()
    return F.broadcast(made) if made.count() <= limit else made

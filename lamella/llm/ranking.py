"""Top N items within every group.

Top N is two-stage: each group is hashed into subgroups, N are kept in each, and the
survivors are ranked by score and identifier. A group of any size therefore ends in a
window of at most salts x N rows.

Defined cases. Ties in score go to the identifier, then equal rows are equal and any
one of them may be the one kept. A null N keeps nothing. Null scores come last; a
null group is a group of its own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top_n(rows: DataFrame, group: Sequence[str], order: Sequence[Column], salt_on: Sequence[str], n: Column, most: int, salts: int = SALTS) -> DataFrame:
    """The first ``n`` rows of each group in ``order``.

    ``n`` may differ by group and must not exceed ``most``; ``salt_on`` are the columns
    hashed to subgroups (the identifier of an item).
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
    inner = Window.partitionBy(*group, "_salt").orderBy(*order)
    survivors = salted.withColumn("_rank", F.row_number().over(inner)).where(F.col("_rank") <= int(most)).where(F.col("_rank") <= n)
    outer = Window.partitionBy(*group).orderBy(*order)
    ranked = survivors.drop("_salt").withColumn("_rank", F.row_number().over(outer)).where(F.col("_rank") <= int(most))
    return ranked.where(F.col("_rank") <= n).drop("_rank")

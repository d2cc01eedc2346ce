"""Small helpers over DataFrames."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def column_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return df[name] if name in df.columns else F.lit(None).cast(kind)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """With these columns, each computed once a row: a generator's output isn't put into the filters and expressions that read it."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def all_of(predicates: list[Column]) -> Column:
    """The conjunction; of none it is true."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def first_rows(df: DataFrame, keys: list[str], order: list[Column], out: str = "_rn", n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order (Spark plans a per-group limit before the shuffle)."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= n).drop(out)


def latest(df: DataFrame, keys: list[str], values: list[str], by: list[str]) -> DataFrame:
    """The values of each key's row that is last by `by`: combined before the one shuffle."""
    top = F.max_by(F.struct(*values), F.struct(*by)).alias("_top")
    return df.groupBy(*keys).agg(top).select(*keys, "_top.*")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a loop with a reliable checkpoint in the folder that the session names in spark.checkpoint.dir (one of our own only where it names none)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)

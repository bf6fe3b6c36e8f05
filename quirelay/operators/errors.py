"""Rows that failed: a result-or-error column through Python stages, and a table of their own for the failures.

A stage gives each row a result or an ``error``, never an exception that would fail the whole job (and be retried on the same row in
vain). ``contained`` parts the two; the failures are written with the stage's name and counted.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def said(e: BaseException) -> str:
    """What is kept of an exception: its kind and its first line."""
    return f"{type(e).__name__}: {(str(e).splitlines() or [''])[0][:200]}"


def tried(f: Callable, kind: str):
    """A column function for ``f``, called row by row inside Arrow batches: struct<value, error>, one of them null."""

    @F.pandas_udf(f"struct<value:{kind},error:string>")
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        values, errors = [], []
        for row in rows.itertuples(index=False, name=None):
            try:
                values.append(f(*row))
                errors.append(None)
            except Exception as e:
                values.append(None)
                errors.append(said(e))
        return pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series(errors, dtype=object)})

    return lambda *columns: run(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"c{k}") for k, c in enumerate(columns)]))


def contained(rows: DataFrame, stage: str, keys: list[str], path: str | None = None, error: str = "error") -> DataFrame:
    """``rows`` without those that have an error; these are appended to the table at ``path`` as (stage, key, error), if it is given."""
    failed = F.col(error).isNotNull()
    if path:
        bad = rows.where(failed).select(F.lit(stage).alias("stage"), F.to_json(F.struct(*keys)).alias("key"), F.col(error).alias("error"))
        bad.write.mode("append").parquet(path)
    return rows.where(~failed).drop(error)


def counted(failures: DataFrame) -> DataFrame:
    """Failures by stage and kind of error."""
    return failures.groupBy("stage", F.substring_index("error", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def parsed(texts: DataFrame, column: str, schema: str, out: str = "value") -> DataFrame:
    """JSON text as ``out``; a text that isn't JSON of the schema gets an ``error`` instead of failing."""
    full = schema[:-1] + ",_corrupt_record:string>"
    got = F.from_json(F.col(column), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    broken = F.col(column).isNotNull() & F.coalesce(F.col("__got._corrupt_record").isNotNull(), F.lit(True))
    return texts.withColumn("__got", got).select(
        *texts.columns, F.when(~broken, F.col("__got").dropFields("_corrupt_record")).alias(out), F.when(broken, F.concat(F.lit("NotJson: "), F.substring(column, 1, 80))).alias("error")
    )

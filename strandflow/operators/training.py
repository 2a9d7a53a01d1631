"""Control of training runs, as queries over their check-ins; and models as functions of batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def early_stopping(checks: DataFrame, keys: Sequence[str], order: str, value: str, patience: int) -> DataFrame:
    """(keys, last_check, best, stopped): a run stops once more than `patience` checks in a row bring no new best."""
    window = Window.partitionBy(*keys).orderBy(order)
    before = F.max(value).over(window.rowsBetween(Window.unboundedPreceding, -1))
    rows = checks.select(*keys, order, value, F.when(before.isNull() | (F.col(value) > before), F.col(order)).alias("__record"))
    waited = F.row_number().over(window) - F.max(F.when(F.col("__record").isNotNull(), F.col("__nth"))).over(window)
    rows = rows.withColumn("__nth", F.row_number().over(window)).withColumn("waited", waited)
    rows = rows.withColumn("__over", F.sum(F.when(F.col("waited") > patience, 1).otherwise(0)).over(window))
    # All checks until the first that stops the run, that one included.
    seen = rows.where((F.col("__over") == 0) | ((F.col("__over") == 1) & (F.col("waited") == patience + 1)))
    return seen.groupBy(*keys).agg(F.max(order).alias("last_check"), F.max(value).alias("best"), F.bool_or(F.col("waited") > patience).alias("stopped"))


def predict(batches: DataFrame, load: Callable[[], Callable], x: str = "x", p: str = "p") -> DataFrame:
    """Rows with a prediction for the array in column x. `load` runs once for each task and returns the model: a function
    from a list of arrays to a list of arrays of numbers."""
    kept = batches.select(*[c for c in batches.columns if c != p])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for part in parts:
            found = pa.array(model(part.column(x).to_pylist()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, p])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(p, T.ArrayType(T.DoubleType()))]))


def with_context(bases: DataFrame, keys: Sequence[str], base: str = "base", pos: str = "pos", reach: int = 3) -> DataFrame:
    """Bases with the characters around them as columns c-reach … c+reach; N beyond the edges."""
    window = Window.partitionBy(*keys).orderBy(pos)
    around = [F.coalesce(F.lead(base, k).over(window) if k > 0 else F.lag(base, -k).over(window) if k < 0 else F.col(base), F.lit("N")).alias(f"c{k:+d}") for k in range(-reach, reach + 1)]
    return bases.select("*", *around)


def baseline(train: DataFrame, cls: str = "cls", reach: int = 3):
    """A logistic regression on the characters around a base, fitted by Spark: a model for when there are no weights.

    Takes rows of with_context(); predictions of the fitted model go through probabilities().
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    names = [f"c{k:+d}" for k in range(-reach, reach + 1)]
    index = StringIndexer(inputCols=names, outputCols=[f"i{n}" for n in names], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"i{n}" for n in names], outputCols=[f"h{n}" for n in names])
    return Pipeline(stages=[index, hot, VectorAssembler(inputCols=[f"h{n}" for n in names], outputCol="features"), LogisticRegression(labelCol=cls, maxIter=30, regParam=1e-4)]).fit(train)


def probabilities(model, rows: DataFrame, p: str = "p") -> DataFrame:
    """Rows with the class probabilities of a fitted baseline as an array."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).select(*rows.columns, vector_to_array("probability").alias(p))

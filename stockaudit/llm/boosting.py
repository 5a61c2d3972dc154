"""Boosted trees on labelled rows: a bounded sample of them, or all with a weight each."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from stockaudit.llm.tables import free_name

# Bounds of a training sample, and the size of the model.
SAMPLE_ROWS = 10_000
TREES = 12
DEPTH = 4
# Spark takes the cuts of a feature from all rows if they are no more than the square of its bins.
BINS, MOST_BINS = 32, 1024


def bounded_sample(labelled: DataFrame, key: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The ``rows`` rows with the smallest key, stored; the same at every partitioning if the key is of the values."""
    from stockaudit.operators.joins import stored

    return stored(labelled.orderBy(key).limit(rows))


def fit(sample: DataFrame, features: Sequence[str], label: str, weight: str | None = None) -> Transformer | None:
    """A model for ``scored``; None if the sample holds only one class, or no row.

    Where rows have a weight, the number of equal rows that each stands for, cuts are taken from all of them up to a million.
    """
    if sample.select(label).distinct().count() < 2:
        return None
    name = free_name(sample.columns, "features")
    assembler = VectorAssembler(inputCols=list(features), outputCol=name, handleInvalid="keep")
    trees = GBTClassifier(featuresCol=name, labelCol=label, predictionCol=f"{name}_class", maxIter=TREES, maxDepth=DEPTH, seed=7)
    if weight is not None:
        trees.setWeightCol(weight).setMaxBins(min(MOST_BINS, max(BINS, math.ceil(math.sqrt(sample.count())))))
    trees.setProbabilityCol(f"{name}_probability").setRawPredictionCol(f"{name}_raw")
    return PipelineModel([assembler, trees.fit(assembler.transform(sample))])


def scored(model: Transformer, df: DataFrame, score: str) -> DataFrame:
    """``df`` with the probability of class 1."""
    out = model.transform(df)
    probability = model.stages[-1].getProbabilityCol()
    return out.select(*df.columns, vector_to_array(F.col(probability))[1].alias(score))

"""Precision reducer: snap every element of a vector column to a grid.

``round(v / p) * p`` per element, with the JVM's half-up rounding
``floor(x + 0.5)`` (so -2.5 -> -2, unlike SQL ``round``).  Implemented with
built-in higher-order functions on the array form of the vector, so it runs
inside whole-stage codegen instead of a Python UDF.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def reduce_precision(vec: Column, precision: float) -> Column:
    p = F.lit(float(precision))
    return array_to_vector(F.transform(vector_to_array(vec), lambda x: F.floor(x / p + 0.5) * p))


class _ReducerParams(HasInputCol, HasOutputCol):
    precision = Param(Params._dummy(), "precision", "grid step of the reduced values",
                      typeConverter=TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(precision=0.01)

    def getPrecision(self) -> float:
        return self.getOrDefault(self.precision)

    def _check(self, schema: T.StructType) -> None:
        out = self.getOutputCol()
        if out in schema.fieldNames():
            raise ValueError(f"Output column {out} already exists.")
        dt = schema[self.getInputCol()].dataType
        if not isinstance(dt, VectorUDT):
            raise TypeError(f"Input type {dt} did not match VectorType")


class PrecisionReducerModel(Model, _ReducerParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, precision=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self._check(dataset.schema)
        return dataset.withColumn(self.getOutputCol(),
                                  reduce_precision(F.col(self.getInputCol()), self.getPrecision()))


class PrecisionReducer(Estimator, _ReducerParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, precision=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def setInputCol(self, value):
        return self._set(inputCol=value)

    def setOutputCol(self, value):
        return self._set(outputCol=value)

    def setPrecision(self, value):
        return self._set(precision=value)

    def _fit(self, dataset: DataFrame) -> PrecisionReducerModel:
        self._check(dataset.schema)
        m = PrecisionReducerModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(),
                                  precision=self.getPrecision())
        return self._copyValues(m)

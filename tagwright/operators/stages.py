"""Feature operators as ``pyspark.ml`` stages, to be chained in a ``Pipeline``, saved and loaded."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession

from tagwright.functions import text
from tagwright.operators.vocabulary import document_frequency, features_in_range, keep_features, term_counts
from tagwright.storage import store


class CountBlock(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Listings -> long table of token counts of one column; ``tokenizer`` maps a column to its tokens.

    A tokenizer of ``functions.text``, given as such or by name, can be saved with the stage; others live in the session.
    """

    field = Param(Params._dummy(), "field", "column that is counted", TypeConverters.toString)
    tokenizer = Param(Params._dummy(), "tokenizer", "name of a tokenizer of functions.text", TypeConverters.toString)

    def __init__(self, field: str | None = None, tokenizer=None) -> None:
        super().__init__()
        self._own = None
        if field is not None:
            self._set(field=field)
        if isinstance(tokenizer, str):
            self._set(tokenizer=tokenizer)
        elif tokenizer is not None and getattr(text, getattr(tokenizer, "__name__", ""), None) is tokenizer:
            self._set(tokenizer=tokenizer.__name__)
        else:
            self._own = tokenizer

    def write(self) -> MLWriter:
        if self._own is not None:
            raise ValueError("only a tokenizer of functions.text can be saved")
        return super().write()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        field = self.getOrDefault(self.field)
        tokens = self._own or getattr(text, self.getOrDefault(self.tokenizer))
        return term_counts(dataset, field, tokens(dataset[field]))


class DropByDf(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fit the features whose document frequency lies in range; the model keeps those of any long table."""

    min_df = Param(Params._dummy(), "min_df", "least number of rows", TypeConverters.toInt)
    max_df = Param(Params._dummy(), "max_df", "largest share of rows", TypeConverters.toFloat)

    def __init__(self, min_df: int = 1, max_df: float = 1.0) -> None:
        super().__init__()
        self._set(min_df=min_df, max_df=max_df)

    def _fit(self, dataset: DataFrame) -> DropByDfModel:
        low, high = self.getOrDefault(self.min_df), self.getOrDefault(self.max_df)
        rows = dataset.select("item_id").distinct().count() if high < 1.0 else None
        kept = features_in_range(document_frequency(dataset), low, high, rows)
        return DropByDfModel(store(kept, "fitted-features"))


class DropByDfModel(Model, MLReadable, MLWritable):
    """A fitted ``DropByDf``; its feature table is saved with it."""

    def __init__(self, features: DataFrame) -> None:
        super().__init__()
        self.features = features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return keep_features(dataset, self.features)

    def write(self) -> MLWriter:
        return _FeaturesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FeaturesReader()


class _FeaturesWriter(MLWriter):
    def __init__(self, model: DropByDfModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.features.write.parquet(f"{path}/features")


class _FeaturesReader(MLReader):
    def load(self, path: str) -> DropByDfModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = DropByDfModel(spark.read.parquet(f"{path}/features"))
        model._resetUid(metadata["uid"])
        return model

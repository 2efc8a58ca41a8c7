"""Scorers for names and URLs: score 0..100 of a text column.

A scorer takes a frame and a text column name and returns the frame with a
``score`` column.  The default scorers are plain expressions; a trained
``pyspark.ml`` model or any batch function can be plugged in instead, and is
then applied to distinct texts only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chars, encode_domain, encode_url

Scorer = Callable[[DataFrame, str], DataFrame]


def name_score(text: Column) -> Column:
    """Score of a host name from its first label: many distinct characters,
    digits and length look generated."""
    label = F.substring_index(F.lower(text), ".", 1)
    distinct = F.size(F.array_distinct(chars(label)))
    digits = F.length(F.regexp_replace(label, "[^0-9]", ""))
    raw = 3 * distinct + 2 * digits + F.length(label) - 12
    return F.least(F.greatest(raw, F.lit(0)), F.lit(100)).cast("int")


def url_score(text: Column) -> Column:
    """Score of a URL from its quoting, operators, keywords and length."""
    marks = F.length(F.regexp_replace(text, r"[^'\"<>;()=]", ""))
    words = F.size(F.regexp_extract_all(F.lower(text), F.lit(r"(select|union|script|passwd|exec|\.\./)"), F.lit(1)))
    raw = 10 * marks + 30 * words + F.call_function("div", F.length(text), F.lit(10))
    return F.least(raw, F.lit(100)).cast("int")


def expression_scorer(score: Callable[[Column], Column]) -> Scorer:
    return lambda df, name: df.withColumn("score", score(F.col(name)))


default_name_scorer = expression_scorer(name_score)
default_url_scorer = expression_scorer(url_score)


def _on_distinct(df: DataFrame, name: str, scored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    texts = df.select(F.col(name).alias("_text")).distinct()
    result = scored(texts).select("_text", "score")
    return df.join(result, F.col(name) == F.col("_text")).drop("_text")


def batch_scorer(load: Callable[[], Callable], kind: str = "domain") -> Scorer:
    """Scorer around a batch model on integer-encoded texts.

    ``load`` runs once per Python worker and returns a function from a 2-D
    integer array to scores in 0..1.
    """
    encode = encode_domain if kind == "domain" else encode_url

    def scorer(df: DataFrame, name: str) -> DataFrame:
        @F.pandas_udf("int")
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for codes in batches:
                if len(codes) == 0:
                    yield pd.Series([], dtype="int32")
                    continue
                yield pd.Series((np.asarray(model(np.stack(codes.to_numpy()))) * 100).astype("int32"))

        return _on_distinct(df, name, lambda t: t.withColumn("score", predict(encode(F.col("_text")))))

    return scorer


def train_scorer(labelled: DataFrame, text: str = "text", label: str = "label", features: int = 4096):
    """Fit a character-bigram logistic regression on (text, label 0/1) rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer

    stages = [RegexTokenizer(inputCol="_text", outputCol="_chars", pattern="", minTokenLength=1),
              NGram(n=2, inputCol="_chars", outputCol="_grams"),
              HashingTF(inputCol="_grams", outputCol="features", numFeatures=features),
              LogisticRegression(labelCol="_label", maxIter=20, regParam=0.01)]
    rows = labelled.select(F.col(text).alias("_text"), F.col(label).cast("double").alias("_label"))
    return Pipeline(stages=stages).fit(rows)


def model_scorer(model) -> Scorer:
    """Scorer of a model fitted by ``train_scorer``."""
    from pyspark.ml.functions import vector_to_array

    def scored(texts: DataFrame) -> DataFrame:
        out = model.transform(texts)
        return out.withColumn("score", F.floor(vector_to_array("probability")[1] * 100).cast("int"))

    return lambda df, name: _on_distinct(df, name, scored)

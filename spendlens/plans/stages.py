"""pyspark.ml stages wrapping the feature operators, so that features and
classifier are fitted, saved and loaded as ONE ``PipelineModel`` and scoring
reuses the training statistics.

Fitted values are small (a handful of floats and at most ``top_k`` merchant
names), kept as Params and persisted with ``DefaultParamsWritable``.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import tfidf as TF


class _FeatureParams(Params):
    textCol = Param(Params._dummy(), "textCol", "text column", TypeConverters.toString)
    amountCol = Param(Params._dummy(), "amountCol", "amount column", TypeConverters.toString)
    merchantCol = Param(Params._dummy(), "merchantCol", "merchant column",
                        TypeConverters.toString)
    topMerchants = Param(Params._dummy(), "topMerchants", "number of merchant one-hots",
                         TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(textCol="description", amountCol="amount", merchantCol="merchant",
                         topMerchants=0)


class TransactionFeatures(Estimator, _FeatureParams, DefaultParamsReadable,
                          DefaultParamsWritable):
    """Fits amount statistics (one aggregate) and, optionally, the top merchants."""

    @keyword_only
    def __init__(self, textCol="description", amountCol="amount", merchantCol="merchant",
                 topMerchants=0):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "TransactionFeaturesModel":
        k = self.getOrDefault("topMerchants")
        st = FE.AmountStats.fit(df, self.getOrDefault("amountCol"),
                                merchant_col=self.getOrDefault("merchantCol") if k else None,
                                top_k=k)
        m = TransactionFeaturesModel()
        m._set(textCol=self.getOrDefault("textCol"), amountCol=self.getOrDefault("amountCol"),
               merchantCol=self.getOrDefault("merchantCol"), topMerchants=k,
               median=float(st.median or 0.0), q75=float(st.q75 or 0.0),
               mean=float(st.mean or 0.0), stdPop=float(st.std_pop or 0.0),
               merchants=list(st.top_merchants))
        return m


class TransactionFeaturesModel(Model, _FeatureParams, DefaultParamsReadable,
                               DefaultParamsWritable):
    median = Param(Params._dummy(), "median", "fitted median", TypeConverters.toFloat)
    q75 = Param(Params._dummy(), "q75", "fitted 75th percentile", TypeConverters.toFloat)
    mean = Param(Params._dummy(), "mean", "fitted mean", TypeConverters.toFloat)
    stdPop = Param(Params._dummy(), "stdPop", "fitted population sd", TypeConverters.toFloat)
    merchants = Param(Params._dummy(), "merchants", "fitted top merchants",
                      TypeConverters.toListString)

    def __init__(self):
        super().__init__()
        self._setDefault(median=0.0, q75=0.0, mean=0.0, stdPop=0.0, merchants=[])

    def stats(self) -> FE.AmountStats:
        return FE.AmountStats(self.getOrDefault("median"), self.getOrDefault("q75"),
                              self.getOrDefault("mean"), self.getOrDefault("stdPop"))

    def feature_names(self) -> list[str]:
        from .. import constants as K
        names = ["word_count", "char_count", "avg_word_length"]
        for cat in K.FEATURE_KEYWORDS:
            names += [f"has_{cat}_keyword", f"{cat}_keyword_count"]
        names += ["log_amount", "amount_large", "amount_medium", "amount_small", "amount_scaled"]
        names += [f"merchant_{m}" for m in self.getOrDefault("merchants")]
        return names

    def _transform(self, df: DataFrame) -> DataFrame:
        """An absent input column counts as NULL, and a feature that has no
        value (of a NULL amount) is 0, so every row can be scored."""
        absent = {self.getOrDefault("textCol"): "string", self.getOrDefault("amountCol"): "double"}
        if self.getOrDefault("merchants"):
            absent[self.getOrDefault("merchantCol")] = "string"
        df = df.withColumns({c: F.lit(None).cast(t) for c, t in absent.items()
                             if c not in df.columns})
        out = FE.engineer_features(df, self.stats(), self.getOrDefault("textCol"),
                                   self.getOrDefault("amountCol"))
        out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                               for c in self.feature_names() if not c.startswith("merchant_")})
        ms = self.getOrDefault("merchants")
        if ms:
            hot = FE.merchant_onehot(F.col(self.getOrDefault("merchantCol")), ms)
            out = out.withColumns({c: F.coalesce(x, F.lit(0)) for c, x in hot.items()})
        return out


class _TfidfParams(Params):
    textCol = Param(Params._dummy(), "textCol", "text column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "size of the vocabulary",
                        TypeConverters.toInt)
    minDF = Param(Params._dummy(), "minDF", "least documents (or share) of a term",
                  TypeConverters.toFloat)
    maxDF = Param(Params._dummy(), "maxDF", "most documents (or share) of a term",
                  TypeConverters.toFloat)
    sublinear = Param(Params._dummy(), "sublinear", "1 + ln(count)", TypeConverters.toBoolean)
    ngramMax = Param(Params._dummy(), "ngramMax", "longest word n-gram", TypeConverters.toInt)
    stopWords = Param(Params._dummy(), "stopWords", "dropped words", TypeConverters.toListString)

    def __init__(self):
        super().__init__()
        self._setDefault(textCol="description", outputCol="tfidf", maxFeatures=100, minDF=1.0,
                         maxDF=1.0, sublinear=True, ngramMax=2, stopWords=[])

    def tfidf_params(self) -> TF.TfidfParams:
        g = self.getOrDefault
        return TF.TfidfParams(g("maxFeatures"), g("minDF"), g("maxDF"), g("sublinear"),
                              g("ngramMax"), tuple(g("stopWords")))


class TfidfVectorizer(Estimator, _TfidfParams, DefaultParamsReadable, DefaultParamsWritable):
    """F12-F14 as a stage: fits the vocabulary and its idf."""

    @keyword_only
    def __init__(self, textCol="description", outputCol="tfidf", maxFeatures=100, minDF=1.0,
                 maxDF=1.0, sublinear=True, ngramMax=2, stopWords=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> TfidfModel:
        rows = df.withColumn("__doc", F.monotonically_increasing_id())
        vocabulary = TF.fit_vocabulary(rows, "__doc", self.getOrDefault("textCol"),
                                       self.tfidf_params(), unique_ids=True).orderBy("index").collect()
        model = TfidfModel()
        self._copyValues(model)
        return model._set(terms=[r["term"] for r in vocabulary], idf=[r["idf"] for r in vocabulary])


class TfidfModel(Model, _TfidfParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the tf-idf vector of each row: a projection without a shuffle."""

    terms = Param(Params._dummy(), "terms", "vocabulary in index order",
                  TypeConverters.toListString)
    idf = Param(Params._dummy(), "idf", "their idf", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(terms=[], idf=[])

    def vocabulary(self) -> list[str]:
        return list(self.getOrDefault("terms"))

    def _transform(self, df: DataFrame) -> DataFrame:
        text = self.getOrDefault("textCol")
        if text not in df.columns:
            df = df.withColumn(text, F.lit(None).cast("string"))
        out = TF.with_terms(df, text, self.tfidf_params())
        w = TF.sparse_weights(F.col("__terms"), self.vocabulary(), list(self.getOrDefault("idf")),
                              self.getOrDefault("sublinear"))
        return out.withColumn(self.getOrDefault("outputCol"), w).drop("__terms")


class NonNegative(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable,
                  DefaultParamsWritable):
    """Entries below 0 become 0: rows may lie outside of the range a min-max
    scaling was fitted on."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        entries = F.transform(vector_to_array(F.col(self.getInputCol())),
                              lambda x: F.greatest(x, F.lit(0.0)))
        return df.withColumn(self.getOutputCol(), array_to_vector(entries))


class MeanProbability(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """M9: mean of the members' class probabilities and its first largest class."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        members = [vector_to_array(F.col(c)) for c in self.getInputCols()]
        total = members[0]
        for m in members[1:]:
            total = F.zip_with(total, m, lambda a, b: a + b)
        mean = F.transform(total, lambda x: x / F.lit(float(len(members))))
        out = df.withColumn("probability", array_to_vector(mean))
        best = F.array_position(mean, F.array_max(mean)) - 1
        return out.withColumn("prediction", best.cast("double"))

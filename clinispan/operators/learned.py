"""A learned assertion classifier to hold the rules against: n-grams of the words on either side, and logistic regression."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, IDFModel, IndexToString, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinispan.operators.evaluate import winner
from clinispan.operators.joins import lookup_join

#: Characters of context on each side of a finding.
LEFT, RIGHT = 60, 40
SIDES = ("left", "right")
WORDS = r"\w\w+"


class DampedCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Term counts c as 1 + ln c, zeros as they are."""

    @keyword_only
    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        counts = vector_to_array(self.getInputCol())
        return dataset.withColumn(self.getOutputCol(), array_to_vector(F.transform(counts, lambda c: F.when(c > 0, 1 + F.ln(c)).otherwise(0.0))))


def contexts() -> SQLTransformer:
    """Adds left and right: the lower-cased characters before start and after end."""
    return SQLTransformer(statement=f"SELECT *, lower(substring(text, greatest(start - {LEFT}, 0) + 1, least(start, {LEFT}))) AS left, lower(substring(text, end + 1, {RIGHT})) AS right FROM __THIS__")


def _side(side: str) -> list:
    """Words of two characters or more, their 1- to 3-grams that two rows have, damped and weighed by rarity, scaled to length 1."""
    words = RegexTokenizer(inputCol=side, outputCol=f"{side}_words", pattern=WORDS, gaps=False, toLowercase=False)
    grams = [NGram(n=n, inputCol=f"{side}_words", outputCol=f"{side}_{n}") for n in (1, 2, 3)]
    joined = SQLTransformer(statement=f"SELECT *, concat({side}_1, {side}_2, {side}_3) AS {side}_grams FROM __THIS__")
    return [words, *grams, joined, CountVectorizer(inputCol=f"{side}_grams", outputCol=f"{side}_counts", minDF=2), DampedCounts(inputCol=f"{side}_counts", outputCol=f"{side}_damped"), IDF(inputCol=f"{side}_damped", outputCol=f"{side}_idf"), Normalizer(inputCol=f"{side}_idf", outputCol=f"{side}_unit")]


def build_classifier(n: int, c: float = 4.0) -> Pipeline:
    """An unfitted pipeline for n training rows (text, start, end, assertion); c is the inverse strength of the penalty, summed over rows."""
    label = StringIndexer(inputCol="assertion", outputCol="label", handleInvalid="keep", stringOrderType="alphabetAsc")
    features = VectorAssembler(inputCols=["left_unit", "right_unit"], outputCol="features")
    learner = LogisticRegression(family="multinomial", regParam=1 / (c * max(n, 1)), maxIter=200, standardization=False)
    return Pipeline(stages=[contexts(), *_side("left"), *_side("right"), features, label, learner])


def train(rows: DataFrame, c: float = 4.0) -> PipelineModel:
    return build_classifier(rows.count(), c).fit(rows)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with learned, the predicted assertion."""
    labels = next(s for s in model.stages if hasattr(s, "labels")).labels
    named = IndexToString(inputCol="prediction", outputCol="learned", labels=[*labels, "unknown"])
    return named.transform(model.transform(rows)).select(*rows.columns, "learned")


def compare(rows: DataFrame) -> DataFrame:
    """One row from rows (assertion, learned, rule): accuracies, the winner, and negated findings that each system calls present."""

    def right(c: str) -> Column:
        return F.avg((F.col(c) == F.col("assertion")).cast("int"))

    def leak(c: str) -> Column:
        return F.count_if((F.col("assertion") == "absent") & (F.col(c) == "present"))

    out = rows.agg(F.count("*").alias("n"), right("learned").alias("learned_accuracy"), right("rule").alias("rule_accuracy"), leak("learned").alias("learned_absent_to_present"), leak("rule").alias("rule_absent_to_present"))
    return out.withColumn("winner", winner(F.col("learned_accuracy"), F.col("rule_accuracy"), ("learned", "rules")))


def exported(spark: SparkSession, model: PipelineModel) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A fitted classifier as tables: features (side, gram, idf), weights (side, gram, label, weight) and intercepts (label, place, intercept).

    They say all that score() needs, so that a model can be kept, read, compared and applied without the library that fitted it. Weights of 0 are left out.
    """
    counts = [s for s in model.stages if isinstance(s, CountVectorizerModel)]
    rarity = [s.idf.toArray() for s in model.stages if isinstance(s, IDFModel)]
    fitted = model.stages[-1]
    names = [*next(s for s in model.stages if isinstance(s, StringIndexerModel)).labels, "unknown"][: fitted.numClasses]
    matrix, features, weights, first = fitted.coefficientMatrix.toArray(), [], [], 0
    for side, vocabulary, idf in zip(SIDES, (c.vocabulary for c in counts), rarity, strict=True):
        for i, gram in enumerate(vocabulary):
            features.append((side, gram, float(idf[i])))
            weights += [(side, gram, n, float(w)) for n, w in zip(names, matrix[:, first + i], strict=True) if w]
        first += len(vocabulary)
    intercepts = [(n, i, float(b)) for i, (n, b) in enumerate(zip(names, fitted.interceptVector.toArray(), strict=True))]
    return spark.createDataFrame(features, "side string, gram string, idf double"), spark.createDataFrame(weights, "side string, gram string, label string, weight double"), spark.createDataFrame(intercepts, "label string, place int, intercept double")


def grams(rows: DataFrame, key: str = "id") -> DataFrame:
    """key, side, gram, n: how often each run of one to three words stands beside a finding of rows (key, text, start, end)."""
    both = contexts().transform(rows).select(key, *SIDES)
    sides = both.select(key, F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.regexp_extract_all(s, F.lit(WORDS), F.lit(0)).alias("w")) for s in SIDES))).alias("x")).select(key, "x.side", "x.w")

    def runs(n: int) -> Column:
        whole = F.filter(F.transform("w", lambda _, i: F.slice(F.col("w"), i + 1, F.lit(n))), lambda g: F.size(g) == n)
        return F.transform(whole, lambda g: F.array_join(g, " "))

    return sides.select(key, "side", F.explode_outer(F.concat(*map(runs, (1, 2, 3)))).alias("gram")).where("gram is not null").groupBy(key, "side", "gram").agg(F.count("*").alias("n"))


def score(rows: DataFrame, features: DataFrame, weights: DataFrame, intercepts: DataFrame, key: str = "id") -> DataFrame:
    """key, label and score of each label for rows (key, text, start, end), by joins and sums of the tables of exported(); key must identify rows.

    Grams are joined with the tables by lookup_join, so neither a large vocabulary nor a frequent word gathers in one task.
    """
    known = lookup_join(grams(rows, key), features, ["side", "gram"], "inner").withColumn("v", (1 + F.ln("n")) * F.col("idf"))
    length = known.groupBy(key, "side").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    # Weights add up before they are divided by the length of their side, which is the same for all of them.
    sums = lookup_join(known.select(key, "side", "gram", "v"), weights, ["side", "gram"], "inner").groupBy(key, "side", "label").agg(F.sum(F.col("v") * F.col("weight")).alias("sum"))
    parts = sums.join(length, [key, "side"]).groupBy(key, "label").agg(F.sum(F.try_divide("sum", "length")).alias("parts"))
    every = rows.select(key).join(F.broadcast(intercepts))
    return every.join(parts, [key, "label"], "left").select(key, "label", "place", (F.col("intercept") + F.coalesce("parts", F.lit(0.0))).alias("score"))


def predict_by_tables(rows: DataFrame, features: DataFrame, weights: DataFrame, intercepts: DataFrame, key: str = "id") -> DataFrame:
    """rows with learned: the label of the highest score, the first of equal ones."""
    best = score(rows, features, weights, intercepts, key).groupBy(key).agg(F.max_by("label", F.struct("score", -F.col("place"))).alias("learned"))
    return rows.join(best, key)

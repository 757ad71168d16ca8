"""Intent data and features: TF-IDF, dataset statistics, stratified folds, a trained classifier."""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import evaluate


def tfidf(df: DataFrame, key: str, tokens: Column, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """key, term, weight: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), not normalised."""
    total = df.agg(F.count("*").alias("_n"))
    tf = df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    seen = tf.groupBy("term").agg(F.count("*").alias("df"))
    kept = seen.crossJoin(F.broadcast(total)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("_n")))  # one row
    weight = (1 + F.log(F.col("tf").cast("double"))) * (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1)
    return tf.join(kept, "term").select(key, "term", weight.alias("weight"))


def stats(df: DataFrame, label: str, source: str) -> DataFrame:
    """Counts and mean text length in total, by label and by source."""
    return df.groupingSets([[], [label], [source]], label, source).agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("mean_length"))


def _hash(key: str) -> Column:
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")


def ranked(df: DataFrame, key: str, label: str, buckets: int = 256) -> DataFrame:
    """``df`` with ``place``, a row's place (from 0) within its label by hash and key; and ``of``, the label's rows.

    Places are counted within ranges of the hash and added to the rows of the ranges before, so no task holds a whole
    label.  A null label is one of the labels.
    """
    h = F.col("_h")
    # floor(h * buckets / 2^32) keeps the order of the hash
    d = df.withColumn("_h", _hash(key)).withColumn("_b", F.floor(F.coalesce(h, F.lit(0)) * buckets / (1 << 32)))
    sizes = d.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))  # at most ``buckets`` rows a label
    upto = W.partitionBy("_l").orderBy("_c")
    sizes = sizes.select("_l", "_c", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy("_l")).alias("of"))
    d = d.withColumn("_r", F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", key)))
    d = d.join(sizes, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_c")))
    return d.withColumn("place", F.col("_before") + F.col("_r") - 1).drop("_h", "_b", "_l", "_c", "_r", "_before")


def stratified(df: DataFrame, key: str, label: str, n: int = 5) -> DataFrame:
    """A fold for each row: within each label rows are dealt out in turn, so its folds differ by one row at most."""
    return ranked(df, key, label).withColumn("fold", F.pmod("place", F.lit(n)).cast("int")).drop("place", "of")


def split(df: DataFrame, key: str, label: str, held: float = 0.2) -> DataFrame:
    """``df`` with ``test``: within each label a share ``held`` of the rows, to the nearest row, is held out."""
    return ranked(df, key, label).withColumn("test", F.col("place") < F.round(F.col("of") * held)).drop("place", "of")


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """``df`` with a ``weight`` that gives each label the same total; one small row a label is joined back."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))  # one row
    weights = sizes.crossJoin(F.broadcast(total)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(weights, label)


def _accents() -> tuple[str, str]:
    """Latin letters with marks, and the same without, by Unicode's decomposition."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b and a.islower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


class LogCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Counts of a sparse vector as 1 + ln of them."""

    @keyword_only
    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        def dampened(v):
            return Vectors.sparse(v.size, v.indices, 1 + np.log(v.values))

        return df.withColumn(self.getOutputCol(), F.udf(dampened, VectorUDT())(self.getInputCol()))


def features(min_df: int = 2, max_df: float = 0.95, most: int = 15_000) -> list:
    """Stages from (text, label) to ``target`` and normalised TF-IDF ``features`` of word 1- to 3-grams; rows without a known label are left out.

    Accents are stripped, words have two characters at least, and a term's weight grows with 1 + ln of its count.
    """
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer

    return [
        StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc", handleInvalid="skip"),
        SQLTransformer(statement=f"SELECT *, translate(lower(text), '{ACCENTED}', '{PLAIN}') AS plain FROM __THIS__"),
        RegexTokenizer(inputCol="plain", outputCol="w1", pattern=r"(?U)\W+", minTokenLength=2),
        NGram(n=2, inputCol="w1", outputCol="w2"),
        NGram(n=3, inputCol="w1", outputCol="w3"),
        SQLTransformer(statement="SELECT *, concat(w1, w2, w3) AS grams FROM __THIS__"),
        CountVectorizer(inputCol="grams", outputCol="tf", minDF=min_df, maxDF=max_df, vocabSize=most),
        LogCounts(inputCol="tf", outputCol="logtf"),
        IDF(inputCol="logtf", outputCol="idf"),
        Normalizer(inputCol="idf", outputCol="features"),
    ]


def training_pipeline(max_iter: int = 1000):
    """TF-IDF and a multinomial logistic regression on (text, label, weight)."""
    from pyspark.ml import Pipeline

    return Pipeline(stages=[*features(), classifier("logistic", max_iter=max_iter)])


def classifier(kind: str, trees: int = 200, max_iter: int | None = None):
    """``logistic`` (multinomial), ``forest`` or ``svm`` (one against the rest), weighted by ``weight``; at most 1000 and 2000 iterations of the first and last."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier

    common = {"featuresCol": "features", "labelCol": "target", "weightCol": "weight"}
    if kind == "logistic":
        return LogisticRegression(family="multinomial", maxIter=max_iter or 1000, regParam=0.001, standardization=False, **common)
    if kind == "forest":
        return RandomForestClassifier(numTrees=trees, maxDepth=20, seed=42, **common)
    if kind == "svm":
        return OneVsRest(classifier=LinearSVC(maxIter=max_iter or 2000, regParam=0.002), rawPredictionCol="rawPrediction", **common)
    raise ValueError(f"unknown classifier {kind!r}")


def _margins(model, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).withColumn("margins", vector_to_array("rawPrediction"))


def calibrated_svm(train: DataFrame, classes: int, key: str, parts: int = 3, max_iter: int | None = None):
    """A function that adds ``probability`` (array, by target) to prepared rows.

    Every row's margins come from a model that has not seen its part; a logistic curve a class is fitted to them and
    applied to the margins of a model of all rows.  Only two numbers a class reach the driver.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    dealt = stratified(train, key, "label", parts).persist()
    held = [_margins(classifier("svm", max_iter=max_iter).fit(dealt.where(F.col("fold") != k)), dealt.where(F.col("fold") == k)) for k in range(parts)]
    out = held[0]
    for h in held[1:]:
        out = out.unionByName(h)
    out = out.select("target", "margins", "weight").persist()
    curves = []
    for c in range(classes):
        rows = out.select((F.col("target") == c).cast("double").alias("y"), array_to_vector(F.array(F.col("margins")[c])).alias("m"), "weight")
        fit = LogisticRegression(featuresCol="m", labelCol="y", family="binomial", regParam=1e-4, maxIter=max_iter or 1000).fit(rows)
        curves.append((float(fit.coefficients[0]), float(fit.intercept)))
    out.unpersist()
    dealt.unpersist()
    model = classifier("svm", max_iter=max_iter).fit(train)

    def apply(df: DataFrame) -> DataFrame:
        raw = F.array(*[1 / (1 + F.exp(-(a * F.col("margins")[c] + b))) for c, (a, b) in enumerate(curves)])
        scaled = _margins(model, df).withColumn("_p", raw).withColumn("_s", F.aggregate("_p", F.lit(0.0), lambda x, y: x + y))
        return scaled.withColumn("probability", F.expr("transform(_p, p -> p / _s)")).drop("_p", "_s", "margins", "rawPrediction", "prediction")

    return apply


def ensemble(train: DataFrame, key: str, weights: tuple[float, float, float] = (2, 1, 1), trees: int = 200, parts: int = 3, max_iter: int | None = None):
    """Labels in order, and a function from (``key``, text) rows to them with ``votes``: the weighted mean of the
    probabilities of logistic regression, calibrated SVM and forest fitted on ``train`` (``key``, text, label)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    prepare = Pipeline(stages=features()).fit(train)
    rows = balanced(prepare.transform(train)).select(key, "label", "target", "features", "weight").persist()
    labels = list(prepare.stages[0].labels)
    logistic, forest = classifier("logistic", max_iter=max_iter).fit(rows), classifier("forest", trees).fit(rows)
    svm = calibrated_svm(rows, len(labels), key, parts, max_iter)
    rows.unpersist()

    def apply(df: DataFrame) -> DataFrame:
        ready = prepare.transform(df.withColumn("label", F.lit(labels[0]))).select(key, "text", "features")
        first = svm(ready).withColumnRenamed("probability", "_svm")
        second = logistic.transform(first).withColumn("_log", vector_to_array("probability")).drop("probability", "rawPrediction", "prediction")
        third = forest.transform(second).withColumn("_rf", vector_to_array("probability"))
        return third.select(key, "text", soft_vote([F.col("_log"), F.col("_svm"), F.col("_rf")], list(weights)).alias("votes"))

    return labels, apply


def soft_vote(probabilities: list[Column], weights: list[float]) -> Column:
    """Weighted mean of probability arrays."""
    total = sum(weights)
    out = F.transform(probabilities[0], lambda x: x * (weights[0] / total))
    for p, w in zip(probabilities[1:], weights[1:], strict=True):
        out = F.zip_with(out, F.transform(p, _scaled(w / total)), lambda a, b: a + b)
    return out


def _scaled(w: float):
    return lambda x: x * w


def probabilities(votes: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """key, label, p: a row a label, from ``votes`` in the labels' order."""
    names = F.array(*map(F.lit, labels))
    return votes.select(key, F.explode(F.zip_with(names, "votes", lambda a, b: F.named_struct(F.lit("label"), a, F.lit("p"), b))).alias("x")).select(key, "x.label", "x.p")


def evaluated(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> dict:
    """Accuracy, weighted F1, the report of each class and the confusion matrix of predicted rows; a row a class reaches the driver."""
    classes = evaluate.report(rows.select(F.col(label).alias("t"), F.col(predicted).alias("p")), "t", "p")
    report = {r.label: {"precision": r.precision, "recall": r.recall, "f1": r.f1, "support": r.support} for r in classes.collect()}
    means = {r.average: {"precision": r.precision, "recall": r.recall, "f1": r.f1} for r in evaluate.averages(classes).collect()}
    cells = {(r.t, r.p): r.n for r in evaluate.confusion(rows.select(F.col(label).alias("t"), F.col(predicted).alias("p")), "t", "p").collect()}
    names, total = sorted(report), max(sum(cells.values()), 1)
    return {"accuracy": sum(cells.get((x, x), 0) for x in names) / total, "f1_weighted": means["weighted"]["f1"], "averages": means, "report": report, "labels": names, "confusion": [[cells.get((a, b), 0) for b in names] for a in names]}


def _predicted(model, df: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, model.stages[0].labels))
    return model.transform(df).select("*", F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"))


def cross_validated(df: DataFrame, key: str, n: int = 5, max_iter: int = 100) -> tuple[list[float], float, float]:
    """Weighted F1 of the logistic pipeline on each of ``n`` stratified folds of (``key``, text, label), their mean and population deviation."""
    dealt = stratified(df, key, "label", n).persist()
    scores = []
    for k in range(n):
        model = training_pipeline(max_iter).fit(balanced(dealt.where(F.col("fold") != k)))
        scores.append(evaluated(_predicted(model, dealt.where(F.col("fold") == k)))["f1_weighted"])
    dealt.unpersist()
    mean = sum(scores) / n
    return scores, mean, (sum((x - mean) ** 2 for x in scores) / n) ** 0.5


def trained(examples: DataFrame, key: str, folds: int = 5, max_iter: int = 100):
    """A fitted pipeline and its metrics: a stratified split, cross-validation on the training part, a final fit, and a test."""
    dealt = split(examples, key, "label").persist()
    train, test = dealt.where(~F.col("test")), dealt.where("test")
    scores, mean, deviation = cross_validated(train.drop("test"), key, folds, max_iter)
    model = training_pipeline(max_iter).fit(balanced(train))
    found = evaluated(_predicted(model, test))
    out = {"cv_f1": scores, "cv_f1_mean": mean, "cv_f1_std": deviation, "train_size": train.count(), "test_size": test.count(), "test": found}
    dealt.unpersist()
    return model, out


def predicted(model, df: DataFrame, key: str) -> DataFrame:
    """key, label, p of ``df`` (``key``, text) by a fitted pipeline."""
    from pyspark.ml.functions import vector_to_array

    labels = list(model.stages[0].labels)
    ready = df.select(key, "text", F.lit(labels[0]).alias("label"), F.lit(1.0).alias("weight"))
    return probabilities(model.transform(ready).select(key, vector_to_array("probability").alias("votes")), key, labels)

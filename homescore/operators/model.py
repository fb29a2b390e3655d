"""Extender recommendation: labels, split, class weights, classifiers, metrics and scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import Imputer, ImputerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homescore.config import SWEEP_FEATURES, ForestParams, ModelFamilies, RecommendationRules
from homescore.functions.numeric import hash_bucket, percent
from homescore.operators.dataset import with_increment
from homescore.operators.report import model_family
from homescore.sources.files import union_all

LABEL = "enhance_flag"
WEIGHT = "class_weight"


def enhance_label(df: DataFrame, threshold: float = 0, increment: str = "score_increment") -> DataFrame:
    """1 where the score rose by more than `threshold`."""
    return df.withColumn(LABEL, F.when(F.col(increment) > threshold, 1).otherwise(0))


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(LABEL).agg(F.count("*").alias("count"))


def label_sweep(df: DataFrame, thresholds: Sequence[float] = (0, 5, 10)) -> DataFrame:
    """Class counts for several thresholds, in one pass over the rows."""
    flags = F.array(
        *[
            F.struct(
                F.lit(t).cast("int").alias("threshold"),
                F.when(F.col("score_increment") > t, 1).otherwise(0).alias(LABEL),
            )
            for t in thresholds
        ]
    )
    return df.select(F.inline(flags)).groupBy("threshold", LABEL).agg(F.count("*").alias("count"))


def with_split(df: DataFrame, key: str = "serial_num", seed: int = 42, parts: int = 5) -> DataFrame:
    """Mark one part in `parts` of the keys as test rows.

    The mark depends on the key alone, so a re-run task or another row order cannot change it.
    """
    return df.withColumn("is_test", hash_bucket(F.col(key), seed, parts) == 0)


def class_weights(train: DataFrame) -> DataFrame:
    """Balanced weight of each class: rows / (2 * rows of the class)."""
    counts = label_counts(train)
    total = counts.agg(F.sum("count").alias("n")).scalar()
    return counts.withColumn(WEIGHT, F.try_divide(total * F.lit(1.0), 2 * F.col("count")))


def with_class_weight(train: DataFrame) -> DataFrame:
    """Rows with the weight of their class; the weights are two rows."""
    return train.join(F.broadcast(class_weights(train).drop("count")), LABEL)


def imputer(columns: Sequence[str]) -> Imputer:
    """Fill missing values of each column with its mean."""
    return Imputer(strategy="mean", inputCols=list(columns), outputCols=list(columns))


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return imputer(columns).fit(df).transform(df)


def assembler(features: Sequence[str], on_missing: str = "error") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid=on_missing)


def forest(params: ForestParams = ForestParams()) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol=LABEL,
        weightCol=WEIGHT,
        numTrees=params.trees,
        maxDepth=params.depth,
        minInstancesPerNode=params.min_leaf,
        bootstrap=True,
        seed=params.seed,
    )


def logistic(train_rows: int) -> LogisticRegression:
    """Logistic regression with an L2 penalty of unit strength over all rows."""
    return LogisticRegression(
        labelCol=LABEL,
        weightCol=WEIGHT,
        standardization=False,
        regParam=1.0 / max(train_rows, 1),
        elasticNetParam=0.0,
        tol=1e-12,
        maxIter=1000,
    )


def complete(features: Sequence[str], imputed: Sequence[str] = ()) -> Column:
    """Rows whose features, but for those that are imputed, are all there."""
    known = [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in features if f not in imputed]
    return reduce(and_, known, F.lit(True))


def fit_forest(
    train: DataFrame,
    features: Sequence[str] = SWEEP_FEATURES,
    imputed: Sequence[str] = (),
    params: ForestParams = ForestParams(),
) -> PipelineModel:
    """Forest with balanced classes; MLlib trains it over the partitions of `train`.

    Homes that lack a feature are not learned from.
    """
    train = train.where(complete(features, imputed))
    steps = [imputer(imputed)] if imputed else []
    return Pipeline(stages=[*steps, assembler(features), forest(params)]).fit(with_class_weight(train))


def fit_logistic(train: DataFrame, features: Sequence[str] = SWEEP_FEATURES) -> PipelineModel:
    train = train.where(complete(features))
    return Pipeline(stages=[assembler(features), logistic(train.count())]).fit(with_class_weight(train))


def logistic_gradient(fitted: PipelineModel, train: DataFrame) -> DataFrame:
    """Gradient of the penalised loss at the fitted coefficients: one row for each, from one aggregation, with
    the feature's mean size as `scale`.

    The loss is strictly convex, so coefficients without gradient are the best ones there are. `train`
    holds the rows learned from.
    """
    _, features = model_inputs(fitted)
    last = fitted.stages[-1]
    rows = with_class_weight(train.where(complete(features)))
    strength = last.getRegParam()
    error = F.col(WEIGHT) * (_chance(last, features) - F.col(LABEL))
    names, values = ("intercept", *features), [F.lit(1.0), *map(F.col, features)]
    sums = [F.sum(error * x).alias(f"g_{k}") for k, x in enumerate(values)]
    sums += [F.sum(F.col(WEIGHT) * F.abs(x)).alias(f"s_{k}") for k, x in enumerate(values)]
    penalty = [0.0, *(strength * c for c in last.coefficients)]
    gradient = lambda k: (F.col(f"g_{k}") / F.col("whole") + F.lit(float(penalty[k]))).alias("gradient")
    scale = lambda k: (F.col(f"s_{k}") / F.col("whole")).alias("scale")
    each = F.array(*[F.struct(F.lit(n).alias("name"), gradient(k), scale(k)) for k, n in enumerate(names)])
    return rows.agg(*sums, F.sum(WEIGHT).alias("whole")).select(F.inline(each))


def _chance(last: LogisticRegressionModel, features: Sequence[str]) -> Column:
    """Probability of class 1 written out from the fitted coefficients."""
    sums = F.lit(float(last.intercept))
    for name, weight in zip(features, last.coefficients):
        sums = sums + F.col(name) * F.lit(float(weight))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-sums))


def keep_model(fitted: PipelineModel, path: str) -> None:
    """Store a fitted model; `kept_model` reads it again, on any later day."""
    fitted.write().overwrite().save(path)


def kept_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def confusion(predicted: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Rows per (label, prediction)."""
    return predicted.groupBy(
        F.col(LABEL).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")
    ).agg(F.count("*").alias("count"))


def classification_metrics(predicted: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Per class precision, recall, F1 and support, and the accuracy, from one pass over the rows."""
    label, guess = F.col(LABEL).cast("int"), F.col(prediction).cast("int")
    per_class = F.array(
        *[
            F.struct(
                F.lit(c).alias("label"),
                F.count_if((label == c) & (guess == c)).alias("hits"),
                F.count_if(guess == c).alias("guessed"),
                F.count_if(label == c).alias("support"),
                F.count_if(label == guess).alias("right"),
                F.count("*").alias("total"),
            )
            for c in (0, 1)
        ]
    )
    rows = predicted.agg(per_class.alias("classes")).select(F.inline("classes"))
    precision = F.try_divide("hits", "guessed")
    recall = F.try_divide("hits", "support")
    return rows.select(
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        F.try_divide(2 * precision * recall, precision + recall).alias("f1"),
        "support",
        F.try_divide("right", "total").alias("accuracy"),
    )


def training_rows(
    installs: DataFrame,
    families: ModelFamilies | None = None,
    rules: RecommendationRules = RecommendationRules(),
) -> DataFrame:
    """Labelled rows of homes that had room to improve, known router models only."""
    rows = installs if families is None else model_family(installs, families)
    gated = rows.where(F.col("before_home_score") > rules.train_score_above)
    return enhance_label(with_increment(gated))


def population_rows(population: DataFrame, rules: RecommendationRules = RecommendationRules()) -> DataFrame:
    """Homes that can be scored: required features present, absent signal bands at fixed values."""
    return (
        population.where(F.col("before_home_score") < rules.deploy_score_below)
        .dropna(subset=list(rules.required))
        .fillna(dict(rules.signal_defaults))
    )


def with_prediction(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows that lack none of the model's features, with its prediction."""
    imputed, features = model_inputs(model)
    return model.transform(df.where(complete(features, imputed)))


def model_inputs(model: PipelineModel) -> tuple[list[str], list[str]]:
    """Columns that a fitted model fills, and those it learned from."""
    imputed = [c for s in model.stages if isinstance(s, ImputerModel) for c in s.getInputCols()]
    features = [c for s in model.stages if isinstance(s, VectorAssembler) for c in s.getInputCols()]
    return imputed, features


def score_population(model: PipelineModel, population: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Probability that a home improves, to 4 places; NULL for homes that lack a feature."""
    imputed, features = model_inputs(model)
    chance = F.round(vector_to_array("probability")[1], 4)
    scored = with_prediction(model, population).select("serial_num", *keep, chance.alias("extender_score"))
    rest = population.where(~complete(features, imputed))
    return scored.union(rest.select("serial_num", *keep, F.lit(None).cast("double").alias("extender_score")))


def recommend(
    installs: DataFrame,
    population: DataFrame,
    families: ModelFamilies | None = None,
    rules: RecommendationRules = RecommendationRules(),
    keep: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train on the installs, and return the hold-out metrics and the scored population.

    With `keep` the fitted model is stored there.
    """
    split = with_split(training_rows(installs, families, rules))
    model = fit_forest(split.where("NOT is_test"), rules.features, rules.imputed, rules.forest)
    if keep:
        keep_model(model, keep)
    metrics = classification_metrics(with_prediction(model, split.where("is_test")))
    scored = score_population(model, population_rows(population, rules), rules.features)
    return metrics, scored


def population_share(
    training: DataFrame,
    population: DataFrame,
    thresholds: Sequence[float] = (0, 5, 10),
    features: Sequence[str] = SWEEP_FEATURES,
    params: ForestParams = ForestParams(),
) -> DataFrame:
    """Per label threshold: homes of the population predicted to improve, and their percentage."""
    parts = []
    for threshold in thresholds:
        model = fit_forest(_train_part(training, threshold), features, params=params)
        predicted = with_prediction(model, population)
        parts.append(
            predicted.agg(
                F.count_if(F.col("prediction") == 0).alias("zeros"),
                F.count_if(F.col("prediction") == 1).alias("ones"),
            ).select(
                F.lit(threshold).cast("int").alias("threshold"),
                "zeros",
                "ones",
                F.round(percent(F.col("ones"), F.col("ones") + F.col("zeros")), 2).alias("ones_pct"),
            )
        )
    return union_all(parts)


def _train_part(training: DataFrame, threshold: float) -> DataFrame:
    return with_split(enhance_label(training, threshold)).where("NOT is_test")


def window_sweep(
    trainings: Mapping[int, DataFrame],
    thresholds: Sequence[float] = (0, 5, 10),
    features: Sequence[str] = SWEEP_FEATURES,
    params: ForestParams = ForestParams(),
) -> DataFrame:
    """Hold-out metrics per window size and label threshold."""
    parts = []
    for days, training in trainings.items():
        for threshold in thresholds:
            split = with_split(enhance_label(training, threshold))
            model = fit_forest(split.where("NOT is_test"), features, params=params)
            metrics = classification_metrics(with_prediction(model, split.where("is_test")))
            parts.append(
                metrics.select(
                    F.lit(days).alias("window_days"), F.lit(threshold).cast("int").alias("threshold"), "*"
                )
            )
    return union_all(parts)

"""Fitted forests as tables, and scores that follow them with built-in functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import ImputerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from homescore.operators.model import complete, model_inputs
from homescore.sources.staging import new_path

#: Nodes that one expression holds; a forest has its number of trees times 2 ** (depth + 1) at most.
MOST_NODES = 200_000


def tree_table(model: PipelineModel) -> DataFrame:
    """One row for each node of a fitted forest: tree, node, feature, threshold, left, right, weight_0, weight_1.

    A home goes left where its feature is at most the threshold. A leaf has no feature and no children;
    its weights are those of the two classes among the training rows that end there. The rows come from
    the form in which MLlib stores a forest.
    """
    forest = next(s for s in model.stages if isinstance(s, RandomForestClassificationModel))
    features = next(s.getInputCols() for s in model.stages if isinstance(s, VectorAssembler))
    spark = SparkSession.getActiveSession()
    path = new_path(spark, "forest")
    forest.write().save(path)
    split, child = F.col("nodeData.split"), lambda side: F.when(F.col(f"nodeData.{side}Child") >= 0, F.col(f"nodeData.{side}Child"))
    names = F.array(*[F.lit(f) for f in features])
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("node"),
        F.when(split["featureIndex"] >= 0, F.get(names, split["featureIndex"])).alias("feature"),
        F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        child("left").alias("left"),
        child("right").alias("right"),
        *[F.get("nodeData.impurityStats", F.lit(c)).alias(f"weight_{c}") for c in (0, 1)],
    )


def _list(values: Sequence[object], kind: str) -> Column:
    """A list of fixed length as one literal, folded once."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def forest_probability(nodes: DataFrame) -> Column:
    """Share of class 1 that a forest given by its nodes finds for the row, from the columns it names.

    Every tree is walked from its node 0; its leaf's shares count alike in all trees. A null feature
    gives null. The nodes, whose number the forest's parameters bound, come to the driver and become lists
    in one expression: rows are neither multiplied nor moved.
    """
    rows = nodes.orderBy("tree", "node").limit(MOST_NODES + 1).collect()
    if not rows or len(rows) > MOST_NODES:
        raise ValueError(f"a forest of 1 to {MOST_NODES} nodes is wanted")
    place = {(r["tree"], r["node"]): k for k, r in enumerate(rows)}
    names = sorted({r["feature"] for r in rows if r["feature"]})
    at = lambda r, side: place[r["tree"], r[side]]
    inner = [r["feature"] is not None for r in rows]
    feature = _list([names.index(r["feature"]) if i else -1 for r, i in zip(rows, inner)], "int")
    limit = _list([float(r["threshold"]) if i else 0.0 for r, i in zip(rows, inner)], "double")
    left = _list([at(r, "left") if i else k for k, (r, i) in enumerate(zip(rows, inner))], "int")
    right = _list([at(r, "right") if i else k for k, (r, i) in enumerate(zip(rows, inner))], "int")
    whole = [r["weight_0"] + r["weight_1"] for r in rows]
    share = _list([float(r["weight_1"] / w) if w else 0.0 for r, w in zip(rows, whole)], "double")
    counts = _list([float(w > 0) for w in whole], "double")
    depth = _depth(rows, place)
    values = F.array(*[F.col(n).cast("double") for n in names]) if names else F.array(F.lit(0.0))
    known = F.lit(True)
    for n in names:
        known = known & F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double"))

    def leaf(root: Column) -> Column:
        step = lambda k, _: F.when(feature[k] < 0, k).when(F.get(values, feature[k]) <= limit[k], left[k]).otherwise(right[k])
        return F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), root, step)

    leaves = F.transform(_list([k for (_, node), k in place.items() if node == 0], "int"), leaf)
    total = lambda of: F.aggregate(leaves, F.lit(0.0), lambda s, k: s + of[k])
    return F.when(known, F.try_divide(total(share), total(counts)))


def _depth(rows: Sequence, place: dict) -> int:
    """Most steps from a root to a leaf."""
    deep, level = 0, [r for r in rows if r["node"] == 0]
    while level := [rows[place[r["tree"], r[side]]] for r in level if r["feature"] is not None for side in ("left", "right")]:
        deep += 1
    return deep


def filled(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with the means that the fitted model puts in place of missing values."""
    for stage in model.stages:
        if isinstance(stage, ImputerModel):
            means = stage.surrogateDF.first().asDict()
            df = df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(v)) for c, v in means.items()})
    return df


def _chance(model: PipelineModel) -> Column:
    """Probability by the tree table, null where a feature of the model is missing, be it in a split or not."""
    imputed, features = model_inputs(model)
    return F.when(complete(features, imputed), forest_probability(tree_table(model)))


def score_with_trees(model: PipelineModel, population: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """`model.score_population` of a forest by following its tree table."""
    return filled(model, population).select("serial_num", *keep, F.round(_chance(model), 4).alias("extender_score"))


def predict_with_trees(model: PipelineModel, df: DataFrame) -> DataFrame:
    """`model.with_prediction` of a forest by following its tree table."""
    rows = filled(model, df).withColumn("__chance", _chance(model)).where("__chance is not null")
    return rows.withColumn("prediction", (F.col("__chance") > 0.5).cast("int")).drop("__chance")

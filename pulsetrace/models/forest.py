"""A fitted forest as a table of nodes, and predictions from that table with column expressions.

The table has one row per node: tree, node, the feature it asks, its threshold or the categories that go left, its
children, and at a leaf the shares of the classes. It can be kept, joined and read without MLlib. Its size is that of
the model, which the driver holds anyway; ``with_votes`` measures it before it is written into an expression.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_scratch
from .training import FittedModel

MAX_NODES = 500_000
NODE = (
    "node:int,feature:int,threshold:double,categories:array<double>,`left`:int,`right`:int,shares:array<double>"
)


def node_table(model: FittedModel) -> DataFrame:
    """(tree, node, feature, threshold, categories, left, right, shares) of a forest or a single tree.

    ``left`` is -1 at a leaf; ``categories`` is null where the feature is a number, ``threshold`` where it is not.
    """
    spark = SparkSession.active()
    path = new_scratch(spark, "forest")
    model.estimator.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    n = F.col("nodeData")
    split, total = n["split"], F.aggregate(n["impurityStats"], F.lit(0.0), lambda a, x: a + x)
    leaf = n["leftChild"] < 0
    category = split["numCategories"] >= 0
    return saved.select(
        F.col("treeID").alias("tree") if "treeID" in saved.columns else F.lit(0).alias("tree"),
        n["id"].alias("node"),
        F.when(~leaf, split["featureIndex"]).alias("feature"),
        F.when(~leaf & ~category, split["leftCategoriesOrThreshold"][0]).alias("threshold"),
        F.when(~leaf & category, split["leftCategoriesOrThreshold"]).alias("categories"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        F.when(leaf, F.transform(n["impurityStats"], lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0))))
        .alias("shares"),
    )


def with_votes(
    rows: DataFrame, nodes: DataFrame, features: list[str], depth: int = 30, max_nodes: int = MAX_NODES
) -> DataFrame:
    """``rows`` with ``votes`` (the shares of the leaves it falls into, summed up over the trees) and ``voted``.

    No join and no shuffle: the table becomes an array of trees inside one expression, so it must be of a bounded size.
    ``features`` names the columns in the model's order; ``depth`` is that of the deepest tree or more.
    """
    size, classes = nodes.agg(F.count("*"), F.max(F.size("shares"))).first()
    if size > max_nodes:
        raise ValueError(f"{size} nodes; at most {max_nodes} are written into an expression")
    columns = F.struct("node", "feature", "threshold", "categories", "left", "right", "shares")
    held = nodes.groupBy("tree").agg(F.sort_array(F.collect_list(columns)).alias("n")).orderBy("tree")
    text = "[" + ",".join(r[0] for r in held.select(F.to_json("n")).collect()) + "]"
    forest = F.from_json(F.lit(text), f"array<array<struct<{NODE}>>>")  # of a literal, so it is made once
    found = rows.withColumn("_x", F.array(*[F.col(c).cast("double") for c in features]))
    zero = F.array(*[F.lit(0.0)] * (classes or 0))

    def vote(sums, tree):
        return F.zip_with(sums, _leaf(tree, F.col("_x"), depth)["shares"], lambda a, b: a + b)

    found = found.withColumn("votes", F.aggregate(forest, zero, vote))
    best = F.array_position("votes", F.array_max("votes")) - 1
    return found.withColumn("voted", best.cast("double")).drop("_x")


def _leaf(tree: Column, x: Column, depth: int) -> Column:
    """The leaf that ``x`` falls into, a step down per level; a node's number is its place in its tree."""
    steps = F.sequence(F.lit(0), F.lit(depth))

    def step(node, _):
        value = F.get(x, node["feature"])
        goes_left = F.when(node["categories"].isNotNull(), F.array_contains(node["categories"], value)).otherwise(
            value <= node["threshold"]
        )
        return F.when(node["left"] < 0, node).otherwise(
            F.get(tree, F.when(goes_left, node["left"]).otherwise(node["right"]))
        )

    return F.aggregate(steps, F.get(tree, F.lit(0)), step)

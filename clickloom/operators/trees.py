"""Boosted trees: training and scoring with Spark ML, leaf features, and fixed tree ensembles as columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.hashing import slot_number
from clickloom.functions.scalar import boosting_probability
from clickloom.operators.vectorize import cell
from clickloom.options import BoostingParams
from clickloom.session import new_path, shared_dir, spread


@dataclass(frozen=True)
class Leaf:
    """A terminal node and the value it predicts."""

    value: float = 0.0


@dataclass(frozen=True)
class Split:
    """An inner node: left when the feature is at most the threshold, or in the category set."""

    feature: str
    left: Split | Leaf
    right: Split | Leaf
    threshold: float | None = None
    categories: tuple[float, ...] = ()

    def goes_left(self) -> Column:
        value = F.col(self.feature)
        return value.isin(*self.categories) if self.threshold is None else value <= self.threshold


def leaves(node: Split | Leaf) -> list[Leaf]:
    """Terminal nodes from left to right."""
    return [node] if isinstance(node, Leaf) else leaves(node.left) + leaves(node.right)


def _choose(node: Split | Leaf, results: list[Column]) -> Column:
    """The entry of ``results`` (one per leaf, left to right) that belongs to the leaf a row reaches."""
    if isinstance(node, Leaf):
        return results[0]
    turn = len(leaves(node.left))
    return F.when(node.goes_left(), _choose(node.left, results[:turn])).otherwise(
        _choose(node.right, results[turn:])
    )


@dataclass(frozen=True)
class Ensemble:
    """A weighted sum of given trees over named columns."""

    trees: tuple[Split | Leaf, ...]
    weights: tuple[float, ...]

    @property
    def leaf_counts(self) -> list[int]:
        return [len(leaves(t)) for t in self.trees]

    def leaf(self, tree: int) -> Column:
        """Position, 0 from the left, of the leaf a row reaches in one tree."""
        root = self.trees[tree]
        return _choose(root, [F.lit(i) for i in range(len(leaves(root)))])

    def raw(self) -> Column:
        """Weighted sum of the leaf values."""
        total: Column = F.lit(0.0)
        for root, w in zip(self.trees, self.weights, strict=True):
            total = total + F.lit(w) * _choose(root, [F.lit(float(n.value)) for n in leaves(root)])
        return total

    def leaf_positions(self) -> Column:
        """array<int>: one leaf position per tree."""
        return F.array(*[self.leaf(i) for i in range(len(self.trees))])

    def score(self, df: DataFrame) -> DataFrame:
        """Add raw_score, probability and the predicted label."""
        return (
            df.withColumn("raw_score", self.raw())
            .withColumn("probability", boosting_probability(F.col("raw_score")))
            .withColumn("prediction", F.when(F.col("raw_score") > 0, 1.0).otherwise(0.0))
        )


# ---- leaf features ----------------------------------------------------------------------------


def leaf_slots(positions: Column, leaf_counts: Sequence[int]) -> Column:
    """array<int>: one feature slot per tree, the tree's leaf position behind the leaves of all trees before.

    Exactly one slot per tree is set, so this array is the sparse form of the one-hot leaf vector.
    """
    starts = [sum(leaf_counts[:i]) for i in range(len(leaf_counts))]
    return F.zip_with(positions, F.lit(starts), lambda p, s: (p + s).cast("int"))


def leaf_line(label: Column, positions: Column, leaf_counts: Sequence[int]) -> Column:
    """Text form of a row: ``label,0,1,0,...``, one entry per leaf of all trees."""
    block = F.zip_with(
        positions,
        F.lit(list(leaf_counts)),
        lambda p, n: F.concat(
            F.repeat(F.lit(",0"), p.cast("int")),
            F.lit(",1"),
            F.repeat(F.lit(",0"), (n - p - 1).cast("int")),
        ),
    )
    return F.concat(label.cast("int").cast("string"), F.array_join(block, ""))


def leaf_cells(slots: Column, leaf_counts: Sequence[int], max_features: int) -> Column:
    """Sparse FTRL cells of a row's leaf slots.

    Equal to writing ``leaf_line``, reading it back by position and hashing every non-zero column: column
    s + 1 of the text holds slot s and the hashed text is ``<column>_1``. The hash of every possible slot
    is known beforehand, so the text detour is not needed.
    """
    numbers = [slot_number(f"{s + 1}_1", max_features) for s in range(sum(leaf_counts))]
    hashed = F.lit(numbers)
    found = F.transform(slots, lambda s: F.element_at(hashed, s + 1))
    starts = [sum(leaf_counts[:t]) for t in range(len(leaf_counts) + 1)]
    own = [set(numbers[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
    if sum(map(len, own)) == len(set().union(*own)):
        # a row has one leaf of each tree, and no slot is shared between trees
        return F.transform(found, lambda s: cell(s, F.lit(1.0)))
    # leaves that share a slot are one cell: squares of gradients are taken per slot
    return F.transform(
        F.array_distinct(found), lambda s: cell(s, F.size(F.filter(found, lambda t: t == s)).cast("double"))
    )


def _checkpoint_folder(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


# ---- Spark ML boosting ------------------------------------------------------------------------


@dataclass(frozen=True)
class BoostedTrees:
    """A trained classifier over named numeric columns."""

    inputs: tuple[str, ...]
    model: GBTClassificationModel

    @staticmethod
    def fit(
        df: DataFrame, inputs: Sequence[str], label: str, params: BoostingParams = BoostingParams()
    ) -> BoostedTrees:
        booster = GBTClassifier(
            labelCol="label",
            featuresCol="features",
            maxIter=params.trees,
            maxDepth=params.depth,
            stepSize=params.learning_rate,
            maxBins=params.bins,
            seed=params.seed,
            leafCol="leaf",
            cacheNodeIds=params.cache_node_ids,
            checkpointInterval=params.checkpoint_interval,
            maxMemoryInMB=params.memory_mb,
        )
        if params.cache_node_ids and params.checkpoint_interval > 0:
            # node ids are checkpointed where the session keeps its scratch tables
            _checkpoint_folder(df.sparkSession)
        labelled = df.withColumn("label", F.col(label).cast("double")).select(*dict.fromkeys(["label", *inputs]))
        # each level of each tree is a pass over the rows, so these are dealt out evenly once
        even = spread(labelled, df.count())
        dense = BoostedTrees._dense(inputs).transform(even).select("label", "features")
        return BoostedTrees(tuple(inputs), booster.fit(dense))

    @staticmethod
    def _dense(inputs: Sequence[str]) -> VectorAssembler:
        return VectorAssembler(inputCols=list(inputs), outputCol="features")

    @property
    def leaf_counts(self) -> list[int]:
        """Leaves per tree, from the trees themselves, so that training and test widths agree."""
        return [(t.numNodes + 1) // 2 for t in self.model.trees]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add raw_score, probability, prediction and leaf_positions (array<int>) in one narrow pass."""
        scored = self.model.transform(self._dense(self.inputs).transform(df))
        out = {
            "raw_score": F.get(vector_to_array("rawPrediction"), F.lit(1)),
            "probability": F.get(vector_to_array("probability"), F.lit(1)),
            "prediction": F.col("prediction"),
            "leaf_positions": vector_to_array("leaf").cast("array<int>"),
        }
        return scored.select(*df.columns, *[c.alias(name) for name, c in out.items()])

    def ensemble(self) -> Ensemble:
        """The trained trees as expressions over the input columns.

        Meant for a few shallow trees, to ship a model as plain columns or to inspect it; ``transform`` is
        the way to score. Collects the node table, whose size depends on the model alone.
        """
        table = {(r["tree"], r["id"]): r for r in self.nodes().collect()}

        def build(tree: int, node: int) -> Split | Leaf:
            r = table[tree, node]
            if r["feature"] is None:
                return Leaf(r["value"])
            return Split(
                self.inputs[r["feature"]],
                build(tree, r["left"]),
                build(tree, r["right"]),
                r["threshold"],
                tuple(r["categories"] or ()),
            )

        roots = tuple(build(t, 0) for t in range(len(self.model.trees)))
        return Ensemble(roots, tuple(self.model.treeWeights))

    def nodes(self) -> DataFrame:
        """Node table of all trees (tree, id, left, right, feature, threshold, categories, value).

        Its size is bounded by the number of trees and their depth.
        """
        spark = SparkSession.active()
        path = new_path(spark, "boosted-trees")
        self.model.write().overwrite().save(path)
        stored = spark.read.parquet(f"{path}/data")
        n = F.col("nodeData")
        split = n["split"]
        inner = n["leftChild"] >= 0
        numeric = inner & (split["numCategories"] < 0)
        return stored.select(
            F.col("treeID").alias("tree"),
            n["id"].alias("id"),
            n["leftChild"].alias("left"),
            n["rightChild"].alias("right"),
            F.when(inner, split["featureIndex"]).alias("feature"),
            F.when(numeric, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
            F.when(inner & ~numeric, split["leftCategoriesOrThreshold"]).alias("categories"),
            n["prediction"].alias("value"),
        )


"""Fit and score one pipeline from its specification.

The fitted pipeline is a plain ``PipelineModel``: category index, vector,
optional one-hot and scaling, estimator. Estimators that pass over the rows
many times keep their own working copy, so nothing is cached here for them. Equal rows of a linear machine or a
perceptron are one row with a weight: each pass then costs what the distinct rows cost.
"""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clusters import align_clusters, cluster_label_map
from ..operators.indexing import MAX_DRIVER_LABELS, CategoryIndex, IndexTable, fit_bounded_index, fit_index
from ..operators.rows import drop_null_rows
from ..sources.layout import COPIES, ROWS_PER_TASK, counted_rows, stable_layout, weighted_layout
from . import network, specs
from .specs import ModelSpec
from .starts import MAX_ITER, TOL, Centres, Start, first_centres, fit_starts, weighted_points

ESTIMATORS = {
    specs.KMEANS: KMeans,
    specs.NAIVE_BAYES: NaiveBayes,
    specs.LINEAR_SVM: LinearSVC,
    specs.RANDOM_FOREST: RandomForestClassifier,
    specs.PERCEPTRON: MultilayerPerceptronClassifier,
}

# Families whose fit passes over the rows many times or samples them per partition.
LAID_OUT = (specs.KMEANS, specs.LINEAR_SVM, specs.RANDOM_FOREST, specs.PERCEPTRON)
# MLlib scales a linear machine's features by a deviation that shrinks with the heaviest weight's share of all rows; rows
# no heavier than this share leave it, and so every step of the fit, as rows without weights have it.
HELD = 100_000


@dataclass
class FittedModel:
    """``tables`` hold the vocabularies too large for the pipeline's own index stage."""

    spec: ModelSpec
    pipeline: PipelineModel
    tables: dict[str, IndexTable] = field(default_factory=dict)

    @property
    def estimator(self):
        return self.pipeline.stages[-1]

    def score(self, df: DataFrame, drop_nulls: bool | None = None) -> DataFrame:
        """Add ``prediction`` (and what else the family reports) to every row kept for scoring."""
        drop = self.spec.drop_test_nulls if drop_nulls is None else drop_nulls
        rows = drop_null_rows(df, self.spec.required_at_test) if drop else df
        return self.pipeline.transform(CategoryIndex([], self.tables).apply_tables(rows))


def training_rows(spec: ModelSpec, train: DataFrame) -> DataFrame:
    return drop_null_rows(train, spec.required) if spec.drop_nulls else train


def read_rows(spec: ModelSpec, train: DataFrame) -> DataFrame:
    """The columns the fit reads of the rows it reads."""
    names = [*spec.categories, *spec.numbers, *(["label"] if spec.supervised else [])]
    return training_rows(spec, train).select(*names)


def laid_out(spec: ModelSpec, rows: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``rows`` in a layout that depends on them alone where that matters; they may be counted already."""
    if by_gradient(spec):
        return weighted_layout(rows, rows_per_task=rows_per_task)
    if spec.family == specs.LINEAR_SVM:
        return weighted_layout(rows, HELD, rows_per_task)
    return stable_layout(rows, rows_per_task) if spec.family in LAID_OUT else rows


def fit_features(
    spec: ModelSpec, train: DataFrame, max_driver_labels: int | None = MAX_DRIVER_LABELS, tracked: int | None = None
) -> FittedModel:
    """The feature half of the pipeline, fitted; ``score`` of the result adds ``features``.

    ``max_driver_labels`` only chooses how an index is held. Trees and one-hot vectors need every
    category as metadata and get it, whatever their number; with ``tracked`` they, and the others, get the
    frequent ones alone, and the rest shares one more (``fit_bounded_index``).
    """
    index = CategoryIndex()
    if spec.categories and tracked is not None:
        index, _ = fit_bounded_index(train, spec.categories, tracked)
    elif spec.categories:
        if spec.one_hot or spec.family == specs.RANDOM_FOREST:
            max_driver_labels = None
        index = fit_index(train, spec.categories, max_driver_labels)
    stages = list(index.models)
    inputs = spec.features
    if spec.one_hot and spec.categories:
        encoded = [f"{c}_vector" for c in spec.categories]
        # The slot it drops is the index's last, the one for unseen values: all zeros.
        encoder = OneHotEncoder(inputCols=inputs[: len(encoded)], outputCols=encoded)
        # Category counts come from the index metadata; no pass over the rows.
        stages.append(encoder.fit(PipelineModel(stages).transform(train)))
        inputs = [*encoded, *inputs[len(encoded):]]
    assembled = "unscaled" if spec.scale else "features"
    stages.append(
        VectorAssembler(inputCols=inputs, outputCol=assembled, handleInvalid=spec.handle_null)
    )
    if spec.scale:
        scaler = StandardScaler(inputCol=assembled, outputCol="features")
        ready = index.apply_tables(train)
        stages.append(scaler.fit(PipelineModel(stages).transform(ready)))
    return FittedModel(spec, PipelineModel(stages), index.tables)


def _estimator(spec: ModelSpec, features: FittedModel, width: int | None = None):
    params = dict(spec.params)
    if spec.family == specs.RANDOM_FOREST:
        # Every category, and the one for unseen values, needs a bin of its own.
        needed = _categories(features) + 1
        if spec.max_bins is not None and needed > spec.max_bins:
            raise ValueError(f"{needed} categories with the unseen one; max_bins is {spec.max_bins}")
        params["maxBins"] = max(params.get("maxBins", 32), needed)
    if spec.family == specs.PERCEPTRON and width is not None:
        params["layers"] = [width, *params["layers"][1:]]
    if spec.supervised:
        params["labelCol"] = "label"
    return ESTIMATORS[spec.family](featuresCol="features", predictionCol="prediction", **params)


def _categories(features: FittedModel) -> int:
    indexes = [s for s in features.pipeline.stages if isinstance(s, StringIndexerModel)]
    return max((len(i.labels) for i in indexes), default=0)


def _vectors(spec: ModelSpec, features: FittedModel, rows: DataFrame) -> DataFrame:
    """Only what the estimator reads, so that nothing else is held during the fit."""
    assembled = features.score(rows, drop_nulls=False)
    weight = [F.col(COPIES).cast("double").alias(COPIES)] if COPIES in rows.columns else []
    return assembled.select("features", *(["label"] if spec.supervised else []), *weight)


def by_gradient(spec: ModelSpec) -> bool:
    """Whether the fit is the descent of ``models/network.py``; MLlib's other solver keeps MLlib's fit."""
    return spec.family == specs.PERCEPTRON and spec.params.get("solver", "l-bfgs") == "l-bfgs"


def fit(
    spec: ModelSpec,
    train: DataFrame,
    max_driver_labels: int | None = MAX_DRIVER_LABELS,
    rows_per_task: int = ROWS_PER_TASK,
    tracked: int | None = None,
    counted: DataFrame | None = None,
) -> FittedModel:
    """The pipeline fitted to ``train``; ``counted`` spares the pass that counts its rows (``counted_rows`` of ``read_rows``)."""
    rows = read_rows(spec, train)
    if counted is None:
        counted = counted_rows(rows) if spec.family in LAID_OUT else rows
    # A sketch and deviations have no weights.
    features = fit_features(spec, rows if spec.scale or tracked is not None else counted, max_driver_labels, tracked)
    vectors = _vectors(spec, features, laid_out(spec, counted, rows_per_task))
    width = None
    if spec.one_hot:
        width = len(vectors.select("features").first()[0])
    estimator = _estimator(spec, features, width)
    if by_gradient(spec):
        model = _perceptron(estimator, vectors)
    else:
        if COPIES in vectors.columns:
            estimator.setWeightCol(COPIES)
        model = estimator.fit(vectors)
    return FittedModel(spec, PipelineModel([*features.pipeline.stages, model]), features.tables)


def _perceptron(estimator: MultilayerPerceptronClassifier, vectors: DataFrame):
    """MLlib's model with the weights to which the descent comes from the weights that MLlib would start from."""
    widths = estimator.getLayers()
    one = SparkSession.active().createDataFrame(
        [(Vectors.dense([0.0] * widths[0]), 0.0)], ["features", "label"]
    )
    start = estimator.copy({estimator.maxIter: 0}).fit(one).weights
    found = network.fit_weights(
        vectors, widths, start.toArray(), COPIES, estimator.getMaxIter(), estimator.getTol()
    )
    held = {estimator.maxIter: 0, estimator.initialWeights: Vectors.dense(found)}
    model = estimator.copy(held).fit(one)
    return model.copy({model.getParam("maxIter"): estimator.getMaxIter()})


@dataclass
class SeedRun(Start):
    kept: bool = False


def fit_kmeans_seeds(
    spec: ModelSpec,
    train: DataFrame,
    seeds: Sequence[int],
    keep: str = "best",
    max_driver_labels: int | None = MAX_DRIVER_LABELS,
    starts: Mapping[int, Centres] | None = None,
) -> tuple[FittedModel, list[SeedRun]]:
    """k-means from every seed, all at once; keep the best silhouette, or the last as a plain loop would.

    ``starts`` gives the first centres of each seed in place of those that the seed would choose.
    """
    params = {"k": 2, "maxIter": MAX_ITER, "tol": TOL, "initMode": "k-means||", **spec.params}
    if params.get("distanceMeasure", "euclidean") != "euclidean":
        raise ValueError("several starts at once are for Euclidean distances")
    names = [*spec.categories, *spec.numbers]
    rows = training_rows(spec, train).select(*names)
    features = fit_features(spec, rows, max_driver_labels)
    points = weighted_points(_vectors(spec, features, rows))
    if starts is None:
        starts = first_centres(points, seeds, params["k"], far=params["initMode"] != "random")
    found = fit_starts(points, {s: starts[s] for s in seeds}, params["maxIter"], params["tol"])
    runs = [SeedRun(**vars(f)) for f in found]
    kept = runs[0]
    for run in runs[1:]:
        if keep == "last" or _better(run, kept):
            kept = run
    kept.kept = True
    model = _from_centres(spec.with_params(seed=kept.seed), features, kept.centres)
    return FittedModel(spec, PipelineModel([*features.pipeline.stages, model]), features.tables), runs


def _from_centres(spec: ModelSpec, features: FittedModel, centres: Centres):
    """MLlib's model of these centres: a fit to them alone, each the only row of its cluster."""
    distinct = [list(c) for c in dict.fromkeys(map(tuple, centres))]
    rows = SparkSession.active().createDataFrame([(Vectors.dense(c),) for c in distinct], ["features"])
    own = spec.with_params(initMode="random", maxIter=1, k=max(2, len(distinct)), solver="row")
    return _estimator(own, features).fit(rows.coalesce(1))


def _better(run: SeedRun, other: SeedRun) -> bool:
    """Whether ``run`` separates better; the earlier seed counts where rounding alone tells them apart."""
    return run.silhouette is not None and (
        other.silhouette is None or run.silhouette > other.silhouette + 1e-9
    )


def align_to_train(model: FittedModel, train: DataFrame, scored: DataFrame) -> DataFrame:
    """Rename the clusters of ``scored`` to the class most of their training rows have."""
    label_map = cluster_label_map(model.score(training_rows(model.spec, train)))
    return align_clusters(scored, label_map)

"""The ten pipelines: one row each, no code per model."""

import json
from dataclasses import dataclass, field, fields, replace

from pyspark.sql.types import StructType

from ..operators.indexing import index_name
from ..schemas import CONN, GROUP

KMEANS, NAIVE_BAYES, LINEAR_SVM = "kmeans", "naive_bayes", "linear_svm"
RANDOM_FOREST, PERCEPTRON = "random_forest", "perceptron"


@dataclass(frozen=True)
class ModelSpec:
    """What a pipeline reads and how it is fitted.

    ``required`` are the columns whose malformed values drop a row before the
    fit; ``drop_nulls`` and ``drop_test_nulls`` tell whether rows with any null
    are dropped from the training and from the test rows. A forest has a bin for
    every category; ``max_bins`` makes a fit that needs more fail.
    """

    name: str
    family: str
    schema: StructType
    categories: tuple[str, ...]
    numbers: tuple[str, ...]
    params: dict = field(default_factory=dict)
    drop_nulls: bool = False
    drop_test_nulls: bool = False
    handle_null: str = "error"
    scale: bool = False
    one_hot: bool = False
    max_bins: int | None = None

    @property
    def supervised(self) -> bool:
        return self.family != KMEANS

    @property
    def features(self) -> list[str]:
        """Vector order: category indexes first, then numbers."""
        return [*map(index_name, self.categories), *self.numbers]

    @property
    def required(self) -> list[str]:
        if self.drop_nulls:
            return list(self.schema.names)
        return [*self.categories, *self.numbers, *(["label"] if self.supervised else [])]

    @property
    def required_at_test(self) -> list[str]:
        if self.drop_test_nulls:
            return list(self.schema.names)
        return [*self.categories, *self.numbers, "label"]

    def to_json(self) -> str:
        return json.dumps({
            **{f.name: getattr(self, f.name) for f in fields(self)},
            "schema": self.schema.jsonValue(),
        })

    @classmethod
    def from_json(cls, text: str) -> "ModelSpec":
        values = json.loads(text)
        values["schema"] = StructType.fromJson(values["schema"])
        return cls(**{k: tuple(v) if k in ("categories", "numbers") else v for k, v in values.items()})

    def with_params(self, **params) -> "ModelSpec":
        return replace(self, params={**self.params, **params})


_CATEGORIES = ("proto", "service", "history")
_COUNTERS = ("orig_bytes", "resp_bytes", "orig_pkts", "orig_ip_bytes", "resp_pkts")
_SESSIONS = ("nses", "cltmoredata", "clt1stappdata")
_TIMES = ("dur_mean", "dur_std", "int_mean", "int_std")


def _conn(name, family, numbers=(), **params):
    return ModelSpec(f"conn_{name}", family, CONN, _CATEGORIES, tuple(numbers), params)


def _group(name, family, numbers, drop_test_nulls=True, **params):
    return ModelSpec(
        f"group_{name}", family, GROUP, (), tuple(numbers), params,
        drop_nulls=True, drop_test_nulls=drop_test_nulls,
    )


# Parameters and seeds of the models, where they are set. k-means has no fixed
# seed of its own; 1 makes it repeatable. The session-group forest grows 30 trees.
SPECS = {
    spec.name: spec
    for spec in (
        _conn("kmeans", KMEANS, k=2, seed=1),
        _conn("naive_bayes", NAIVE_BAYES, ("orig_bytes", "orig_pkts"), modelType="gaussian"),
        _conn("linear_svm", LINEAR_SVM, aggregationDepth=4),
        _conn("random_forest", RANDOM_FOREST, _COUNTERS,
              seed=1234, maxBins=2000, maxDepth=15, numTrees=30),
        _conn("perceptron", PERCEPTRON, (*_COUNTERS, "resp_ip_bytes"),
              layers=[9, 18, 18, 2], seed=1234),
        _group("kmeans", KMEANS, _SESSIONS, drop_test_nulls=False, k=2, seed=1),
        _group("naive_bayes", NAIVE_BAYES, (*_SESSIONS, "dur_std"), modelType="multinomial"),
        _group("linear_svm", LINEAR_SVM, ("dur", *_SESSIONS, *_TIMES), aggregationDepth=2),
        _group("random_forest", RANDOM_FOREST, (*_SESSIONS, *_TIMES),
               seed=1234, impurity="entropy", maxDepth=10, numTrees=30),
        _group("perceptron", PERCEPTRON, ("dur", *_SESSIONS, *_TIMES),
               layers=[8, 16, 16, 2], seed=7986706784745880246),
    )
}

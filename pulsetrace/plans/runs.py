"""Fit, score and evaluate one pipeline."""

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.specs import ModelSpec
from ..models.training import FittedModel, align_to_train, fit
from ..operators import evaluation
from ..sources.typed import accept_rows


@dataclass
class Report:
    """Results of one scored test set; everything but the slices comes from ``cells``.

    ``cells`` is the one grouped count over the scored rows. Where it has been written, pass it
    in; otherwise it is counted again for each result that is asked for.
    """

    scored: DataFrame
    counted: DataFrame | None = None

    @property
    def cells(self) -> DataFrame:
        return evaluation.confusion(self.scored) if self.counted is None else self.counted

    @property
    def named_cells(self) -> DataFrame:
        return evaluation.named_confusion(self.cells)

    @property
    def metrics(self) -> DataFrame:
        return evaluation.metrics(self.cells)

    @property
    def missed(self) -> DataFrame:
        return evaluation.missed_detections(self.scored)

    @property
    def alarms(self) -> DataFrame:
        return evaluation.false_alarms(self.scored)


def typed_train(spec: ModelSpec, labelled: DataFrame) -> DataFrame:
    """Text rows of a labelled dataset, typed for the fit of ``spec``."""
    return accept_rows(labelled, spec.schema, spec.required)


def typed_test(spec: ModelSpec, labelled: DataFrame) -> DataFrame:
    return accept_rows(labelled, spec.schema, spec.required_at_test)


def evaluate(
    model: FittedModel, test: DataFrame, align_with: DataFrame | None = None
) -> Report:
    """Score ``test``; with ``align_with`` (training rows) cluster ids become classes."""
    scored = model.score(test)
    if align_with is not None:
        scored = align_to_train(model, align_with, scored)
    return Report(scored)


def score_all(models: Mapping[str, FittedModel], test: DataFrame) -> DataFrame:
    """``test`` with one column of predictions per model, in one scan; null where the model would drop the row.

    A model that drops rows with nulls is given zeros and empty texts in their place, and its answer is not used.
    """
    own = test.columns
    kept: list[str] = []
    for i, (name, model) in enumerate(models.items()):
        spec = model.spec
        needed = [c for c in spec.required_at_test if c in own] if spec.drop_test_nulls else []
        read = [*spec.categories, *spec.numbers]
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed], F.lit(True))
        hidden = {c: f"_own{i}_{c}" for c in read if c in needed}
        test = test.withColumn(f"_whole{i}", whole).withColumns({new: F.col(c) for c, new in hidden.items()})
        stand_in = {c: F.coalesce(F.col(c), F.lit("" if c in spec.categories else 0).cast(test.schema[c].dataType))
                    for c in hidden}
        scored = model.score(test.withColumns(stand_in), drop_nulls=False)
        answer = F.when(F.col(f"_whole{i}"), F.col("prediction").cast("double")).alias(name)
        back = [F.col(hidden[c]).alias(c) if c in hidden else F.col(c) for c in own]
        test = scored.select(*back, *kept, answer)
        kept.append(name)
    return test


def cells_of_all(models: Mapping[str, FittedModel], test: DataFrame) -> DataFrame:
    """(model, label, prediction, count): the confusion of every model, by one scan and one grouped count."""
    scored = score_all(models, test)
    answers = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("prediction")) for m in models])
    each = scored.select("label", F.explode(answers).alias("a")).select("a.model", "label", "a.prediction")
    return each.where("prediction IS NOT NULL").groupBy("model", "label", "prediction").count()


def metrics_of_all(models: Mapping[str, FittedModel], test: DataFrame) -> DataFrame:
    """A row of metrics per model, from ``cells_of_all``."""
    return evaluation.metrics(cells_of_all(models, test), ["model"])


def run(
    spec: ModelSpec, train: DataFrame, test: DataFrame, align: bool = False
) -> tuple[FittedModel, Report]:
    model = fit(spec, train)
    return model, evaluate(model, test, train if align else None)

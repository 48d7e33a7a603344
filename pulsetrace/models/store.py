"""Save and load fitted pipelines, one folder per pipeline name.

A save writes a complete new version beside the older ones and only then the note that names it, as
one new file. A save that fails leaves the model as it was, and a loaded model can be saved
where it came from. The note also tells which rows the model was fitted to, by their number, schema and a digest
that does not depend on their order; loading can ask for the same ones.
"""

import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.indexing import read_index_table
from .specs import ModelSpec
from .training import FittedModel

NOTE = "contents string"


def fingerprint(spec: ModelSpec, train: DataFrame) -> dict:
    """Number, schema and digest of the rows of a labelled dataset, by one aggregate; repeated rows count."""
    rows = train.select(*spec.schema.names)
    digest = F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))
    n, found = rows.agg(F.count("*"), digest).first()
    return {"rows": n, "schema": rows.schema.simpleString(), "digest": str(found or 0)}


def save(model: FittedModel, root: str, train: DataFrame | None = None) -> str:
    """A new version of ``<root>/<spec name>``: the whole pipeline, any index tables, and ``train``'s fingerprint."""
    path = f"{root.rstrip('/')}/{model.spec.name}"
    spark = SparkSession.active()
    number = max([n for n, _ in _notes(spark, path)], default=0) + 1
    version = f"version-{number}-{uuid.uuid4().hex[:8]}"
    model.pipeline.write().save(f"{path}/{version}/pipeline")
    for column, table in model.tables.items():
        table.df.write.parquet(f"{path}/{version}/index/{column}")
    note = {"version": version, "spec": model.spec.to_json(), "tables": sorted(model.tables)}
    if train is not None:
        note["trained_on"] = fingerprint(model.spec, train)
    (spark.createDataFrame([(json.dumps(note),)], NOTE).coalesce(1)
        .write.text(f"{path}/notes/{number:08d}"))
    return path


def _notes(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of every note that was written to its end."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/notes")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [(int(n), f"{path}/notes/{n}") for n in names
            if n.isdigit() and files.exists(new(f"{path}/notes/{n}/_SUCCESS"))]


def load(spark: SparkSession, path: str, train: DataFrame | None = None) -> FittedModel:
    """The newest complete version; with ``train``, only if it was fitted to these rows."""
    notes = _notes(spark, path)
    if not notes:
        raise FileNotFoundError(f"no saved model below {path}")
    note = json.loads(spark.read.text(max(notes)[1]).first()[0])
    spec = ModelSpec.from_json(note["spec"])
    if train is not None:
        known, asked = note.get("trained_on"), fingerprint(spec, train)
        if known != asked:
            raise ValueError(f"{path} was fitted to {known or 'rows that it does not name'}, not to {asked}")
    base = f"{path}/{note['version']}"
    tables = {c: read_index_table(spark, f"{base}/index/{c}") for c in note["tables"]}
    return FittedModel(spec, PipelineModel.load(f"{base}/pipeline"), tables)

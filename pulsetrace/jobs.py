"""Jobs for spark-submit: ``jobs.py build|fit|evaluate ...``.

build     raw log folders -> labelled train and test datasets
fit       labelled dataset -> saved pipeline
evaluate  saved pipeline + labelled dataset -> metrics, confusion, missed, alarms
"""

import argparse
import json
import random
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsetrace.models import store
from pulsetrace.models.specs import SPECS
from pulsetrace.models.training import fit, fit_kmeans_seeds
from pulsetrace.operators.indexing import MAX_DRIVER_LABELS
from pulsetrace.operators.labeling import union_classes
from pulsetrace.operators.rows import class_summary
from pulsetrace.plans import datasets
from pulsetrace.plans.runs import Report, evaluate
from pulsetrace.schemas import CONN, DOTTED_NAMES, GROUP
from pulsetrace.sources.datasets import read_labelled, read_labelled_csv, write_labelled
from pulsetrace.sources.layout import ROWS_PER_TASK
from pulsetrace.sources.logs import CORRUPT, read_conn_logs, read_group_logs
from pulsetrace.sources.scratch import remove_scratch
from pulsetrace.sources.typed import accept_rows, landed_schema, parse_typed, population

KINDS = {
    "conn": (read_conn_logs, datasets.conn_train, datasets.conn_test, CONN),
    "group": (read_group_logs, datasets.group_train, datasets.group_test, GROUP),
}


def build(spark: SparkSession, kind: str, train: str, test: str, out: str, fmt="parquet"):
    """Write ``<out>/train`` and ``<out>/test``; return their class counts.

    Parquet holds typed rows and the text of malformed fields, so that each model
    can leave out its own unusable rows. CSV holds the fields as they were logged.
    """
    read, label_train, label_test, schema = KINDS[kind]
    summaries = []
    for split, path, label in (("train", train, label_train), ("test", test, label_test)):
        labelled = label(read(spark, path))
        if fmt == "parquet":
            write_labelled(parse_typed(labelled, schema), f"{out}/{split}")
            written = read_labelled(spark, f"{out}/{split}", schema)
        else:
            whole = labelled.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
            write_labelled(whole, f"{out}/{split}", fmt, DOTTED_NAMES)
            written = read_labelled_csv(spark, f"{out}/{split}", schema)
        counts = class_summary(written, "ssl" if kind == "conn" else None)
        summaries.append(counts.select(F.lit(split).alias("split"), "*"))
    return union_classes(*summaries)


def load_labelled(spark: SparkSession, path: str, schema, required, fmt="parquet") -> DataFrame:
    """Typed rows of a labelled dataset, without those unusable for ``required``."""
    if fmt == "csv":
        return accept_rows(read_labelled_csv(spark, path, schema), schema, required)
    return population(read_labelled(spark, path, landed_schema(schema)), required)


def fit_job(
    spark,
    spec_name,
    data,
    models,
    seeds=None,
    keep="best",
    fmt="parquet",
    params=None,
    max_bins=None,
    max_driver_labels=MAX_DRIVER_LABELS,
    rows_per_task=ROWS_PER_TASK,
    tracked=None,
) -> str:
    """Fit and save; ``params`` are set over the pipeline's own estimator parameters."""
    spec = replace(SPECS[spec_name].with_params(**(params or {})), max_bins=max_bins)
    train = load_labelled(spark, data, spec.schema, spec.required, fmt)
    if seeds:
        model, runs = fit_kmeans_seeds(spec, train, seeds, keep, max_driver_labels)
        for run in runs:
            print(f"seed {run.seed} cost {run.cost} silhouette {run.silhouette}{' kept' if run.kept else ''}")
    else:
        model = fit(spec, train, max_driver_labels, rows_per_task, tracked)
    return store.save(model, models, train)


def evaluate_job(spark, model_path, data, out, align_with=None, fmt="parquet") -> Report:
    model = store.load(spark, model_path)
    spec = model.spec
    train = None
    if align_with:
        train = load_labelled(spark, align_with, spec.schema, spec.required, fmt)
    test = load_labelled(spark, data, spec.schema, spec.required_at_test, fmt)
    # Rows and cells are written once: no report scores again, and none but the slices
    # reads the scored rows.
    scored = evaluate(model, test, train).scored.select(*spec.schema.names, "prediction")
    scored.write.mode("overwrite").parquet(f"{out}/scored")
    scored = spark.read.parquet(f"{out}/scored")
    write_labelled(Report(scored).cells, f"{out}/cells")
    report = Report(scored, spark.read.parquet(f"{out}/cells"))
    write_labelled(report.named_cells, f"{out}/confusion")
    write_labelled(report.metrics, f"{out}/metrics")
    write_labelled(report.missed, f"{out}/missed")
    write_labelled(report.alarms, f"{out}/alarms")
    return report


def main(argv=None):
    parser = argparse.ArgumentParser(description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    b = jobs.add_parser("build")
    b.add_argument("kind", choices=KINDS)
    b.add_argument("--train", required=True)
    b.add_argument("--test", required=True)
    b.add_argument("--out", required=True)
    f = jobs.add_parser("fit")
    f.add_argument("spec", choices=SPECS)
    f.add_argument("--data", required=True)
    f.add_argument("--models", required=True)
    f.add_argument("--seeds", nargs="*", type=int, help="k-means: one fit per seed")
    f.add_argument("--rounds", type=int, help="k-means: as many random seeds instead")
    f.add_argument("--rows-per-task", type=int, default=ROWS_PER_TASK, help="rows of one partition of a fit")
    f.add_argument("--max-bins", type=int, help="forests: fail where more bins are needed")
    f.add_argument("--max-driver-labels", type=int, default=MAX_DRIVER_LABELS,
                   help="larger vocabularies are kept as tables, with the same result")
    f.add_argument("--tracked", type=int,
                   help="a power of two: index only values above 3.5 / TRACKED of the rows, from a sketch of fixed size")
    f.add_argument("--param", action="append", default=[], metavar="NAME=VALUE",
                   help="estimator parameter, VALUE as JSON, such as maxIter=200")
    f.add_argument("--keep", choices=("best", "last"), default="best")
    e = jobs.add_parser("evaluate")
    e.add_argument("--model", required=True)
    e.add_argument("--data", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--align-with")
    for job in (b, f, e):
        job.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName(f"pulsetrace {args.job}").getOrCreate()
    if args.job == "build":
        build(spark, args.kind, args.train, args.test, args.out, args.format).show()
    elif args.job == "fit":
        seeds = args.seeds
        if args.rounds:
            seeds = [random.randint(0, 10**11) for _ in range(args.rounds)]
        params = {k: json.loads(v) for k, v in (p.split("=", 1) for p in args.param)}
        print(fit_job(spark, args.spec, args.data, args.models, seeds, args.keep, args.format,
                      params, args.max_bins, args.max_driver_labels, args.rows_per_task, args.tracked))
    else:
        report = evaluate_job(spark, args.model, args.data, args.out, args.align_with, args.format)
        report.named_cells.show()
        report.metrics.show(vertical=True)
    remove_scratch(spark)


if __name__ == "__main__":
    main()

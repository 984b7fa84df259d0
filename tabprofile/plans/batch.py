"""The offline batch run as one call.

load -> clean (empty rows, empty columns, duplicates, optional row and
column caps, optional narrowing) -> cleaned snapshot -> profile tables ->
chart tables -> optional baseline model -> manifest + run log.  Every table
is written by Spark into ``out_dir`` (a shared folder on a cluster).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tabprofile.operators import charts, clean, ml
from tabprofile.plans import report
from tabprofile.operators.target import choose_target, resolve_target
from tabprofile.plans.profile import profile
from tabprofile.session import ensure_checkpoint_dir
from tabprofile.sources import readers, sinks


def clean_table(df: DataFrame, max_rows: int | None = None, max_cols: int | None = None,
                target: str | None = None, narrow: bool = False, dedup: bool = True):
    """P1 -> P2 -> P3 -> P4 -> P5 (-> P7), in the reference's order; returns
    the cleaned frame and the list of steps taken."""
    steps = ["drop_empty_rows", "drop_empty_columns"]
    out = clean.drop_empty_columns(clean.drop_empty_rows(df))
    if dedup:
        out = clean.dedup(out)
        steps.append("drop_duplicates")
    if max_rows is not None:
        out = clean.sample_rows(out, max_rows, seed=42)
        steps.append(f"sample_rows({max_rows})")
    if max_cols is not None and len(out.columns) > max_cols:
        out = clean.cap_columns(out, max_cols, target)
        steps.append(f"cap_columns({max_cols})")
    if narrow:
        out = clean.narrow_types(out)
        steps.append("narrow_types")
    return out, steps


def run_batch(spark: SparkSession, input_path: str, out_dir: str, target: str | None = None, *,
              max_rows: int | None = None, max_cols: int | None = None, charts_on: bool = True,
              train: bool = False, narrow: bool = True, run_log: str | None = None,
              reader_options: dict | None = None) -> dict:
    """``reader_options`` go to :func:`readers.load`, for example ``{"multiline": True}`` for CSV
    with line breaks in quoted fields."""
    ensure_checkpoint_dir(spark)
    raw, target = resolve_target(readers.load(spark, input_path, **(reader_options or {})), target)
    target = choose_target(raw, target, train)
    cleaned, steps = clean_table(raw, max_rows, max_cols, target, narrow=narrow)
    # cut the lineage at the cleaned snapshot: every later table reads it back
    snap = os.path.join(out_dir, "cleaned")
    sinks.write_table(cleaned, snap)
    cleaned = spark.read.parquet(snap)
    outputs = {"cleaned": snap}
    prof = profile(cleaned, target)
    shared = prof.shared | {"pca": prof["multivariate"].get("pca")}

    def write(name, df):
        path = os.path.join(out_dir, "profile", name.replace(".", "/"))
        sinks.write_json(df, path)
        return path
    outputs.update(prof.run_all(write))
    for name, df in {"summary": report.summary_table(cleaned, shared["checks"], shared["dups"]),
                     "numeric": report.numeric_table(cleaned, shared["moments"], shared["quarts"]),
                     "insights": report.insight_table(cleaned, target, shared["checks"], shared["dups"])}.items():
        path = os.path.join(out_dir, "report", name)
        sinks.write_json(df, path)
        outputs[f"report.{name}"] = path
    if charts_on:
        for name, df in charts.chart_data(cleaned, target, shared).items():
            path = os.path.join(out_dir, "charts", name.replace(":", "_"))
            sinks.write_json(df, path)
            outputs[f"chart.{name}"] = path
    accuracy = None
    if train and target:
        res = ml.train_baseline(cleaned, target)
        path = os.path.join(out_dir, "ml")
        sinks.write_json(ml.ml_table(res), path)
        outputs["ml"] = path
        acc = res.metrics.where("metric = 'accuracy'").select("value").first()
        accuracy = acc[0] if acc else None
    man = report.manifest(raw, cleaned, steps, target, outputs, {"charts": charts_on, "train": train})
    sinks.write_json(man, os.path.join(out_dir, "manifest"))
    if run_log:
        sinks.log_run(spark, run_log, os.path.basename(input_path), target_column=target, accuracy=accuracy)
    return outputs

"""Baseline random-forest model and its metrics.

An MLlib pipeline: split (stratified for classes) -> fill values fitted on
the training rows -> StringIndexer
(unknown kept) + OneHotEncoder (the unknown slot dropped, so an unseen
category is the zero vector) -> VectorAssembler -> RandomForest with
balanced class weights.  Rows that MLlib's fit would expand to more than ``GROWN_BYTES`` grow
the same kind of trees over bin numbers (:mod:`tabprofile.operators.forest`).  Metrics come from MLlib evaluators or plain
aggregates over the prediction table; nothing but model parameters and
metric values reaches the driver.

Deviation D10: MLlib forests bin features and need a depth cap; the
reference grows unlimited-depth exact-split trees.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprofile.operators import clean, split
from tabprofile.operators.categorical import value_counts
from tabprofile.operators.forest import grown
from tabprofile.operators.ranks import running
from tabprofile.operators.target import infer_task
from tabprofile.roles import ColumnRoles, normalize, qcol
from tabprofile.session import ensure_checkpoint_dir
from tabprofile.sources.readers import as_number
from tabprofile.sources.sinks import shared_table

# Fixed values that must equal the reference's: forest sizes and guards.
TREES_OFFLINE = 100
MIN_ROWS_OFFLINE = 10
STRATIFY_MAX_CLASSES = 20

TASK_BYTES = 64 << 20  # what MLlib's forest should keep in memory for one task
FEW_TASKS = 4  # rows for no more tasks than these stay where they lie
GROWN_BYTES = 512 << 20  # rows of which MLlib would keep more are binned once and grow its trees by operators/forest.py


@dataclass
class ModelResult:
    task: str
    metrics: DataFrame          # (metric, value)
    confusion: DataFrame | None  # (label, prediction, count)
    importances: DataFrame      # (rank, feature, importance)
    predictions: DataFrame      # test rows: label, prediction (+ probability)


def _error(spark, msg: str) -> ModelResult:
    m = spark.createDataFrame([("error", None, msg)], "metric string, value double, note string")
    e = spark.createDataFrame([], "rank int, feature string, importance double")
    return ModelResult("none", m, None, e, spark.createDataFrame([], "label double, prediction double"))


def _feature_plan(df: DataFrame, target: str):
    roles = ColumnRoles.of(df)
    num = [c for c in roles.numeric if c != target]
    cat = [c for c in df.columns if c != target and roles.roles[c] in ("categorical", "boolean", "datetime")]
    return num, cat


def _fold_rare(train: DataFrame, df_all: list[DataFrame], cat: list[str], max_categories: int | None):
    """All levels, or (an option) the ``max_categories`` most frequent levels of each categorical
    column (by training counts, ties to the smaller value); others become
    ``__other__``.  The kept-level table has at most columns x max_categories
    rows."""
    if not cat or max_categories is None:
        return [d.select(*[qcol(c).cast("string").alias(c) if c in cat else qcol(c) for c in d.columns]) for d in df_all]
    counts = value_counts(train, cat)
    w = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("value"))
    keep = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_categories)
    kept = {}
    for r in keep.select("column_name", "value").collect():  # bounded by columns x max_categories
        kept.setdefault(r["column_name"], []).append(r["value"])
    out = []
    for d in df_all:
        sel = []
        for c in d.columns:
            if c in cat:
                v = qcol(c).cast("string")
                sel.append(F.when(v.isNull(), F.lit(None)).when(v.isin(kept.get(c, [])), v)
                           .otherwise(F.lit("__other__")).alias(c))
            else:
                sel.append(qcol(c))
        out.append(d.select(*sel))
    return out


def train_baseline(df: DataFrame, target: str, *, num_trees: int = TREES_OFFLINE, max_depth: int = 12,
                   min_rows: int = MIN_ROWS_OFFLINE, seed: int = 42, test_fraction: float = 0.2,
                   max_categories: int | None = None, cv_folds: int = 0, task: str | None = None) -> ModelResult:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if target not in df.columns:
        return _error(spark, f"Target column {target!r} not found.")
    df = normalize(df).where(qcol(target).isNotNull())
    n = df.count()
    if n < min_rows:
        return _error(spark, f"Not enough rows with non-null target after dropping NA (need at least {min_rows}).")
    task = task or infer_task(df, target)
    num, cat = _feature_plan(df, target)
    if not num and not cat:
        return _error(spark, "No feature columns left after removing target.")
    # inside, features are c0, c1, ...: MLlib takes no dots in names, and the user's can't clash
    original = {f"c{i}": c for i, c in enumerate(num + cat)}
    df = df.select(*[qcol(c).alias(f"c{i}") for i, c in enumerate(num + cat)], qcol(target).alias("__y"))
    num, cat = [f"c{i}" for i in range(len(num))], [f"c{i + len(num)}" for i in range(len(cat))]
    if task == "classification":
        df = df.withColumn("__y", F.col("__y").cast("string"))
        n_classes = df.select("__y").distinct().limit(STRATIFY_MAX_CLASSES + 1).count()
        if n_classes < 2:
            return _error(spark, "Target has only one class; cannot train.")
        parts = (split.stratified_split(df, "__y", test_fraction, seed) if n_classes < STRATIFY_MAX_CLASSES
                 else split.random_split(df, test_fraction, seed))
    else:
        df = df.withColumn("__y", as_number(df, "__y")).where(F.col("__y").isNotNull())
        if df.count() < min_rows:
            return _error(spark, f"Not enough rows with a numeric target (need at least {min_rows}).")
        parts = split.random_split(df, test_fraction, seed)
    parts = shared_table(parts, "split")
    train = parts.where(F.col("split") == "train").drop("split")
    test = parts.where(F.col("split") == "test").drop("split")
    # fill values fitted on the training rows only; a feature without one has no values there and goes
    fills = shared_table(clean.fill_values(train, num + cat), "fills")
    gone = {r["column_name"] for r in fills.where("fill_value is null").select("column_name").collect()}  # O(columns)
    num, cat = [c for c in num if c not in gone], [c for c in cat if c not in gone]
    if not num and not cat:
        return _error(spark, "No feature column has values in the training rows.")
    fills = fills.where("fill_value is not null")
    parts, train, test = parts.drop(*gone), train.drop(*gone), test.drop(*gone)
    train, test = _prepared(train, [train, test], fills, cat, max_categories)
    stages, vec_inputs = [], list(num)
    for c in cat:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"{c}__idx", outputCol=f"{c}__oh", dropLast=True))
        vec_inputs.append(f"{c}__oh")
    stages.append(VectorAssembler(inputCols=vec_inputs, outputCol="features", handleInvalid="keep"))
    if task == "classification":
        # labels of all rows, so that a class of test rows alone has a code, too
        coder = StringIndexer(inputCol="__y", outputCol="label", stringOrderType="alphabetAsc").fit(df)
        stages.insert(0, coder)
        weights = split.class_weights(train, "__y").select(F.col("class").alias("__y"), "weight")
        train = train.join(weights, "__y")  # one row per class
        model_stage = RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, seed=seed,
                                             featureSubsetStrategy="sqrt", weightCol="weight",
                                             labelCol="label", featuresCol="features",
                                             cacheNodeIds=True, checkpointInterval=10)
    else:
        train = train.withColumn("label", F.col("__y"))
        test = test.withColumn("label", F.col("__y"))
        model_stage = RandomForestRegressor(numTrees=num_trees, maxDepth=max_depth, seed=seed,
                                            featureSubsetStrategy="all", labelCol="label",
                                            featuresCol="features", cacheNodeIds=True, checkpointInterval=10)
    stages.append(model_stage)
    n_train = train.count()
    model = _fitted(train, stages[:-1], model_stage, n_train)
    scored = model.transform(test)
    forest = model.stages[-1]
    importances = _importances(scored, forest, spark, original)
    more = ["__y", "probability"] if task == "classification" else []
    pred = shared_table(scored.select("label", "prediction", *more), "predictions")
    n_test = test.count()
    rows = [("train_size", float(n_train)), ("test_size", float(n_test)),
            ("numeric_features", float(len(num))), ("categorical_features", float(len(cat))),
            ("final_feature_count", float(forest.numFeatures)), ("n_estimators", float(num_trees)),
            ("max_depth", float(max_depth)), ("random_state", float(seed)),
            ("max_bins", float(forest.getOrDefault("maxBins"))), ("min_instances_per_node", float(forest.getOrDefault("minInstancesPerNode"))),
            ("subsampling_rate", float(forest.getOrDefault("subsamplingRate")))]
    if task == "classification":
        labels = coder.labels
        conf = confusion_matrix(pred.select(F.col("__y").alias("label"), F.element_at(
            F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1).alias("prediction")), labels)
        rows += [(r["metric"], r["value"]) for r in classification_metrics(conf).collect()]  # four rows
        if len(labels) == 2:
            from pyspark.ml.functions import vector_to_array
            auc = roc_auc(pred.select("label", vector_to_array("probability")[1].alias("score"))).first()["roc_auc"]
            rows.append(("roc_auc", auc))
        rows += [(f"class_count:{r['__y']}", float(r["count"])) for r in df.groupBy("__y").count().orderBy("__y").collect()]
        if cv_folds and cv_folds > 1:
            rows += _cross_validate(parts.drop("split"), stages[:-1], model_stage, cv_folds, seed, num, cat,
                                    max_categories)
    else:
        rows += [(r["metric"], r["value"]) for r in regression_metrics(pred).collect()]  # two rows
        conf = None
    metrics = spark.createDataFrame([(k, v, None) for k, v in rows], "metric string, value double, note string")
    return ModelResult(task, metrics, conf, importances, pred.select("label", "prediction"))


def _forest_bytes(rows: int, width: int, trees: int) -> int:
    """What MLlib keeps of ``rows`` rows of ``width`` expanded features: a number a feature and two a tree
    for each row, and some objects."""
    return rows * (4 * width + 8 * trees + 200)


def _forest_parts(rows: int, width: int, trees: int) -> int:
    """Tasks for such rows, so that each holds about ``TASK_BYTES``."""
    return max(1, math.ceil(_forest_bytes(rows, width, trees) / TASK_BYTES))


def _fitted(train: DataFrame, prep_stages: list, forest, rows: int) -> PipelineModel:
    """The pipeline of ``prep_stages`` and ``forest`` fitted on the ``rows`` rows of ``train``.

    A stored table of few, well compressed columns is read in one or two tasks however many
    rows it has; the forest keeps far more for a row, so its rows are spread by that size.  Where even
    that is too much, the same trees are grown over bin numbers (:mod:`tabprofile.operators.forest`)."""
    prep = Pipeline(stages=list(prep_stages)).fit(train)
    ready = prep.transform(train)
    width = ready.schema["features"].metadata.get("ml_attr", {}).get("num_attrs", 0)
    if _forest_bytes(rows, width, forest.getNumTrees()) > GROWN_BYTES:
        return PipelineModel(stages=[*prep.stages, grown(ready, prep_stages, forest, rows)])
    parts = _forest_parts(rows, width, forest.getNumTrees())
    if parts > FEW_TASKS:
        used = [c for c in ("features", "label", "weight") if c in ready.columns]
        ready = ready.select(*used).repartition(max(parts, train.sparkSession.sparkContext.defaultParallelism))
    return PipelineModel(stages=[*prep.stages, forest.fit(ready)])


def _prepared(train: DataFrame, tables: list[DataFrame], fills: DataFrame, cat: list[str], max_categories: int | None):
    """Imputed tables whose levels carry a ``=`` before them, as MLlib takes no empty names."""
    tables = _fold_rare(clean.impute(train, fills=fills), [clean.impute(d, fills=fills) for d in tables], cat, max_categories)
    return [d.select(*[F.concat(F.lit("="), qcol(c)).alias(c) if c in cat else qcol(c) for c in d.columns]) for d in tables]


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """M10, exact: one row ``(positives, negatives, roc_auc)`` for labels 0 and 1: the share of
    (positive, negative) pairs in which the positive one scores higher, equal scores counting half.

    Rows are counted by score, and running counts over the sorted scores give each the
    negatives below it (:func:`tabprofile.operators.ranks.running`); no curve is binned.  Rows without
    label or score are left out; NULL if a label has no rows."""
    s = F.nanvl(qcol(score).cast("double"), F.lit(None).cast("double"))
    y = qcol(label).cast("double")
    counts = scored.select(s.alias("s"), y.alias("y")).where("s is not null and y in (0, 1)").groupBy("s").agg(
        F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    placed = running(counts, [F.col("s")], {"below": F.col("n")})
    # in doubles: the number of pairs may pass 2^63
    pairs = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2))
    return placed.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("n"), F.lit(0)).alias("negatives"), pairs.alias("w")).select(
        "positives", "negatives", F.try_divide(F.col("w"), F.col("positives").cast("double") * F.col("negatives")).alias("roc_auc"))


def _importances(pred: DataFrame, forest, spark, original: dict[str, str], top: int = 12) -> DataFrame:
    """Importances over the expanded feature names (vector metadata), with the columns'
    original names: ``column`` or ``column__oh_level``."""
    def named(name):
        column, mark, level = name.partition("__oh_=")
        return original.get(column, column) + (f"__oh_{level}" if mark else "")

    meta = pred.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {}
    for group in meta.values():
        for a in group:
            names[a["idx"]] = named(a.get("name", f"f{a['idx']}"))
    imp = forest.featureImportances.toArray()
    rows = sorted(((names.get(i, f"f{i}"), float(v)) for i, v in enumerate(imp)), key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame([(i + 1, f, v) for i, (f, v) in enumerate(rows[:top])],
                                 "rank int, feature string, importance double")


def _cross_validate(data, prep_stages, model_stage, k, seed, num, cat, max_categories):
    """K-fold stratified accuracy: mean and population std over folds."""
    folded = split.stratified_folds(data, "__y", k, seed)
    folded = shared_table(folded, "folds")
    accs = []
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="accuracy")
    for f in range(k):
        tr = folded.where(F.col("fold") != f).drop("fold")
        te = folded.where(F.col("fold") == f).drop("fold")
        fills = shared_table(clean.fill_values(tr, num + cat), "fills")
        # a feature that happens to have no values in this fold's training rows counts as 0 or ""
        blank = F.when(F.col("strategy") == "median", F.lit("0")).otherwise(F.lit(""))
        fills = fills.withColumn("fill_value", F.coalesce("fill_value", blank))
        tr, te = _prepared(tr, [tr, te], fills, cat, max_categories)
        w = split.class_weights(tr, "__y").select(F.col("class").alias("__y"), "weight")
        m = _fitted(tr.join(w, "__y"), prep_stages, model_stage.copy(), tr.count())
        accs.append(float(ev.evaluate(m.transform(te))))
    mean = sum(accs) / len(accs)
    std = math.sqrt(sum((a - mean) ** 2 for a in accs) / len(accs))
    return [("cv_accuracy_mean", mean), ("cv_accuracy_std", std)]


def onehot_plan(df: DataFrame, cols: list[str] | None = None, max_categories: int | None = None) -> DataFrame:
    """M4: ``(column_name, levels, kept, vector_size)`` per categorical column: distinct
    levels, levels kept (all, or the most frequent ``max_categories``, the rest folded into
    one ``__other__`` level) and the one-hot width (an unseen level maps to the zero vector,
    so it adds no slot)."""
    cols = [c for c in df.columns if ColumnRoles.of(df).roles[c] in ("categorical", "boolean")] if cols is None else cols
    counts = value_counts(df, cols)
    per = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("levels"))
    kept = F.col("levels") if max_categories is None else F.least(F.col("levels"), F.lit(max_categories))
    return per.select("column_name", F.col("levels").cast("long").alias("levels"), kept.cast("long").alias("kept"),
                      (kept + (F.col("levels") > kept).cast("long")).cast("long").alias("vector_size"))


def confusion_matrix(pred: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """M9 on any prediction table: ``(label, prediction, count)``, cells without rows
    included; ``labels`` (default: those that occur) span the grid."""
    counts = pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("count"))
    if labels is None:
        found = counts.select("label").union(counts.select("prediction")).distinct()
        labels = sorted(r[0] for r in found.where("label is not null").collect())  # one row a class
    grid = counts.sparkSession.createDataFrame([(a, b, 0) for a in labels for b in labels], counts.schema)
    return counts.unionByName(grid).groupBy("label", "prediction").agg(F.sum("count").alias("count"))


def classification_metrics(confusion: DataFrame) -> DataFrame:
    """M8 from a confusion matrix: ``(metric, value)`` accuracy and the class-weighted
    precision, recall and f1; a class never predicted has precision 0, an empty matrix
    gives NULLs."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)
    sides = confusion.select(F.col("label").alias("class"), F.col("count").alias("actual"), F.lit(0).cast("long").alias("predicted"),
                             hit.alias("hits")) \
        .unionByName(confusion.select(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("actual"),
                                      F.col("count").alias("predicted"), F.lit(0).cast("long").alias("hits")))
    per = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hits")])  # one row a class
    p, r = (F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col(c)), F.lit(0.0)) for c in ("predicted", "actual"))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))

    def weighted(v):
        return F.try_divide(F.sum(F.col("actual") * v), F.sum("actual"))
    one = per.agg(F.try_divide(F.sum("hits").cast("double"), F.sum("actual")).alias("accuracy"), weighted(p).alias("precision"),
                  weighted(r).alias("recall"), weighted(f1).alias("f1"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                                         for m in ("accuracy", "precision", "recall", "f1")])))


def regression_metrics(pred: DataFrame) -> DataFrame:
    """M13 on any prediction table: ``(metric, value)`` r2 and rmse, rows with both values
    alone; a constant label has no r2 (NULL)."""
    both = pred.where(F.col("label").isNotNull() & F.col("prediction").isNotNull())
    err = F.pow(F.col("label") - F.col("prediction"), 2)
    one = both.agg(F.sum(err).alias("sse"), F.count(F.lit(1)).alias("n"), F.var_pop("label").alias("v"))
    r2 = F.lit(1.0) - F.try_divide(F.col("sse"), F.col("v") * F.col("n"))
    return one.select(F.inline(F.array(F.struct(F.lit("r2").alias("metric"), r2.alias("value")),
                                       F.struct(F.lit("rmse").alias("metric"), F.sqrt(F.try_divide(F.col("sse"), F.col("n"))).alias("value")))))


def ml_table(result: ModelResult) -> DataFrame:
    """``(key, value)`` strings, metrics then top features."""
    m = result.metrics.select(F.col("metric").alias("key"),
                              F.coalesce(F.col("value").cast("string"), F.col("note")).alias("value"))
    i = result.importances.select(F.concat(F.lit("importance:"), F.col("feature")).alias("key"),
                                  F.col("importance").cast("string").alias("value"))
    return m.unionByName(i).select(F.col("key"), F.col("value").cast(T.StringType()))

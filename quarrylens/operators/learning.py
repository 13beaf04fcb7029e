"""Clustering, components, forests and driver models on MLlib."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, Bucketizer, Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.operators.clusters import fit_centres, nearest
from quarrylens.operators.statistics import correlations
from quarrylens.session import materialize, quoted


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    doubles = {c: quoted(c).cast("double") for c in cols}
    return df.withColumns(doubles).dropna(subset=list(cols))


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace columns by z-scores with the population deviation; constant columns become 0."""
    aggs = []
    for i, c in enumerate(cols):
        x = quoted(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = df.agg(*aggs).first()  # two numbers per column
    scaled = {}
    for i, c in enumerate(cols):
        mean, std = row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0
        scaled[c] = (quoted(c).cast("double") - F.lit(mean)) / F.lit(std if std > 0 else 1.0)
    return df.withColumns(scaled)


def vectors(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Complete rows as standardised feature vectors."""
    scaled = standardize(complete_rows(df.select(*dict.fromkeys([*keep, *cols])), cols), cols)
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(scaled)


# --- clusters ----------------------------------------------------------------------------


def kmeans_elbow(df: DataFrame, cols: Sequence[str], kmax: int = 10, seed: int = 42) -> DataFrame:
    """Inertia for k = 2 .. min(kmax, n / 5), all fitted in the same scans of one stored table."""
    scaled = standardize(complete_rows(df.select(*[quoted(c) for c in cols]), cols), cols)
    points = materialize(scaled.select(*[quoted(c) for c in cols]))
    fitted = fit_centres(points, range(2, min(kmax, points.count() // 5) + 1), seed)
    return df.sparkSession.createDataFrame([(k, float(cost)) for k, (_, cost) in fitted.items()], "k int, inertia double")


def kmeans(df: DataFrame, cols: Sequence[str], k: int = 4, seed: int = 42, key: Sequence[str] = ()) -> DataFrame:
    """Rows with their cluster (``prediction``), clustered on standardised columns."""
    names = list(dict.fromkeys([*key, *cols]))
    raw = complete_rows(df.select(*[quoted(c) for c in names]), cols)
    z = [f"_z_{c}" for c in cols]
    data = materialize(standardize(raw.withColumns({f"_z_{c}": quoted(c) for c in cols}), z))
    fitted = fit_centres(data.select(*[quoted(c) for c in z]), [k], seed)
    if k not in fitted:
        raise ValueError(f"fewer than {k} complete rows")
    return data.select(*[quoted(c) for c in names], nearest([quoted(c) for c in z], fitted[k][0]).alias("prediction"))


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    sizes = labelled.groupBy("prediction").agg(F.count(F.lit(1)).alias("samples"))
    return sizes.withColumn("share", F.col("samples") / F.sum("samples").over(Window.partitionBy()))  # a row per cluster


def cluster_profiles(labelled: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of each column per cluster, and the same standardised across the clusters."""
    means = labelled.groupBy("prediction").agg(*[F.avg(quoted(c)).alias(c) for c in cols])
    scaled = standardize(means.withColumns({f"{c}_z": quoted(c) for c in cols}), [f"{c}_z" for c in cols])
    return scaled


# --- components --------------------------------------------------------------------------


def _components(df: DataFrame, cols: Sequence[str], k: int, keep: Sequence[str] = ()):
    data = vectors(df, cols, keep)
    model = PCA(k=k, inputCol="features", outputCol="scores").fit(data)
    return data, model


def pca_variance(df: DataFrame, cols: Sequence[str], max_components: int = 10) -> DataFrame:
    """Explained variance per component, its running total, and whether it is needed for 90%."""
    k = min(len(cols), max_components)
    _, model = _components(df, cols, k)
    rows, total = [], 0.0
    for i, share in enumerate(model.explainedVariance.toArray(), 1):
        rows.append((f"PC{i}", float(share), total + float(share), total < 0.9))
        total += float(share)
    return df.sparkSession.createDataFrame(
        rows, "component string, explained double, cumulative double, within_90 boolean"
    )


def pca_scores(df: DataFrame, cols: Sequence[str], k: int = 2, key: Sequence[str] = ()) -> DataFrame:
    """Component scores of each complete row; each component's largest loading is positive."""
    data, model = _components(df, cols, k, key)
    loadings = model.pc.toArray()
    signs = [1.0 if column[abs(column).argmax()] >= 0 else -1.0 for column in loadings.T]
    scores = vector_to_array(F.col("scores"))
    return model.transform(data).select(
        *key, *[(scores[i] * F.lit(signs[i])).alias(f"pc{i + 1}") for i in range(k)]
    )


# --- forests -----------------------------------------------------------------------------


#: Up to this number every row is fitted by itself; larger tables as weighted cells of rows that no split can part.
FOREST_ROWS = 1 << 20
#: Bins of a feature (MLlib's own number), and the points of its distribution that the bins are cut from.
BINS, POINTS = 32, 4096


def bin_edges(df: DataFrame, cols: Sequence[str]) -> dict[str, list[float]]:
    """Inner edges of at most BINS bins per column, by MLlib's rule, from quantiles over all rows.

    A column of few values gets a bin for each; else bins hold about equally many rows,
    and what follows a frequent value is cut finer.
    """
    probs = F.array(*[F.lit(i / POINTS) for i in range(POINTS + 1)])
    row = df.agg(*[F.percentile_approx(quoted(c), probs, 10 * POINTS).alias(f"p{i}") for i, c in enumerate(cols)]).first()
    edges = {}
    for i, c in enumerate(cols):
        values, counts = np.unique(np.array(row[f"p{i}"] or [0.0]), return_counts=True)
        middles, found, upto, target = (values[1:] + values[:-1]) / 2, [], 0, counts.sum() / BINS
        for j, middle in enumerate(middles):
            upto += counts[j]
            if len(values) <= BINS or abs(upto - target) < abs(upto + counts[j + 1] - target):
                found.append(float(middle))
                target += counts.sum() / BINS
        edges[c] = sorted(set(found[: BINS - 1])) or [float(values[0])]
    return edges


def bins_of(edges: Mapping[str, Sequence[float]], names: Mapping[str, str]) -> Bucketizer:
    """Bin numbers of columns; ``names`` maps each column to be made to the one whose edges it takes."""
    ends = lambda c: [float("-inf"), *edges[c], float("inf")]
    return Bucketizer(splitsArray=[ends(c) for c in names.values()], inputCols=list(names), outputCols=[f"{n}_bin" for n in names])


def weighted(cells: DataFrame, rows: int) -> DataFrame:
    """Cells as rows of about equal weight, so that drawing them resembles drawing rows: at most a FOREST_ROWS-th of all each."""
    parts = F.ceil(F.col("n") / F.lit(max(1.0, rows / FOREST_ROWS)))
    split = cells.withColumn("weight", F.col("n") / parts).withColumn("_part", F.explode(F.sequence(F.lit(1).cast("bigint"), parts)))
    return split.drop("_part")


def _classify_cells(numbers: DataFrame, prepare: Pipeline, rows: int, cols: Sequence[str], forest, accuracy, folds: int, seed: int):
    """Model, holdout accuracy and cross-validation from cells: counts of rows alike in bins, label, holdout and fold."""
    names = [f"_f{i}" for i in range(len(cols))]
    bins = [f"{n}_bin" for n in names]
    known = Pipeline(stages=prepare.getStages()[:-1]).fit(numbers).transform(numbers).select("label", *names)
    labelled = bins_of(bin_edges(known, names), {n: n for n in names}).transform(known)
    split = labelled.withColumns({"test": F.rand(seed) >= 0.8, "fold": F.floor(F.rand(seed + 1) * folds).cast("int")})
    cells = materialize(split.groupBy("label", *bins, "test", "fold").agg(F.count(F.lit(1)).alias("n")))
    data = VectorAssembler(inputCols=bins, outputCol="features").transform(weighted(cells, rows)).select("features", "label", "weight", "test", "fold").persist()
    forest, accuracy = forest.setWeightCol("weight"), accuracy.setWeightCol("weight")
    model = forest.fit(data.where("NOT test"))
    holdout = accuracy.evaluate(model.transform(data.where("test")))
    checked = CrossValidator(
        estimator=forest, estimatorParamMaps=ParamGridBuilder().build(), evaluator=accuracy, numFolds=folds, foldCol="fold", parallelism=2
    ).fit(data)
    data.unpersist()
    return model, holdout, checked


def forest_classify(
    df: DataFrame, target: str, cols: Sequence[str], trees: int = 100, folds: int = 5, seed: int = 42
) -> DataFrame:
    """Feature importance of a random forest, with holdout and cross-validated accuracy.

    Missing numbers take the column mean; the split is 80 / 20. Trees see features by bins, so
    of a table over FOREST_ROWS rows alike in all bins are counted first: the number of
    weighted rows that trees are fitted on has a bound that does not grow with the table.
    """
    numbers = df.where(quoted(target).isNotNull()).select(
        quoted(target).cast("string").alias("_target"), *[quoted(c).cast("double").alias(c) for c in cols]
    )
    names = [f"_f{i}" for i in range(len(cols))]
    prepare = Pipeline(
        stages=[
            Imputer(strategy="mean", inputCols=list(cols), outputCols=names),
            StringIndexer(inputCol="_target", outputCol="label"),
            VectorAssembler(inputCols=names, outputCol="features"),
        ]
    )
    forest = RandomForestClassifier(numTrees=trees, seed=seed)
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy")
    if (size := numbers.count()) > FOREST_ROWS:
        model, holdout, checked = _classify_cells(numbers, prepare, size, cols, forest, accuracy, folds, seed)
    else:
        data = prepare.fit(numbers).transform(numbers).select("features", "label").persist()
        train, test = data.randomSplit([0.8, 0.2], seed=seed)
        model = forest.fit(train)
        holdout = accuracy.evaluate(model.transform(test))
        checked = CrossValidator(
            estimator=forest, estimatorParamMaps=ParamGridBuilder().build(), evaluator=accuracy,
            numFolds=folds, seed=seed, parallelism=2,
        ).fit(data)
        data.unpersist()
    rows = [
        (c, float(v), float(holdout), float(checked.avgMetrics[0]), float(checked.stdMetrics[0]))
        for c, v in zip(cols, model.featureImportances.toArray())
    ]
    return df.sparkSession.createDataFrame(
        rows, "feature string, importance double, holdout_accuracy double, cv_accuracy double, cv_std double"
    ).orderBy(F.desc("importance"), "feature")


def filter_drivers(
    df: DataFrame, outcome: str, drivers: Sequence[str], max_r: float = 0.8
) -> DataFrame:
    """Correlation of each driver with the outcome; a driver that nearly restates it is dropped."""
    cols = [outcome, *drivers]
    pairs = correlations(df, cols, "pearson", None, len(cols)).where(F.col("x") == outcome)
    return pairs.select(
        F.col("y").alias("driver"), "r", (F.coalesce(F.abs("r"), F.lit(0.0)) <= max_r).alias("kept")
    )


def kept_drivers(df: DataFrame, outcome: str, drivers: Sequence[str], max_r: float = 0.8) -> list[str]:
    return [r["driver"] for r in filter_drivers(df, outcome, drivers, max_r).where("kept").orderBy("driver").collect()]


def _regress_cells(rows: DataFrame, size: int, outcome: str, drivers: Sequence[str], forest, seed: int) -> tuple[PipelineModel, float]:
    """Model from the drivers' bins, and r2 of the holdout rows, from cells with the count, mean and variance of the outcome.

    The spread inside a cell is the same on both sides of any split, so the gain of a split
    is that of the rows; the error of the rows is the spread and the distance of the means.
    """
    names = [f"_d{i}" for i in range(len(drivers))]
    bins = [f"{n}_bin" for n in names]
    known = materialize(rows.select(quoted(outcome).alias("label"), *[quoted(c).alias(n) for c, n in zip(drivers, names)]))
    edges = bin_edges(known, names)
    split = bins_of(edges, {n: n for n in names}).transform(known).withColumn("test", F.rand(seed) >= 0.8)
    cells = materialize(split.groupBy(*bins, "test").agg(
        F.count(F.lit(1)).alias("n"), F.avg("label").alias("label"), F.var_pop("label").alias("spread")
    ))
    assembler = VectorAssembler(inputCols=bins, outputCol="features")
    train = assembler.transform(weighted(cells.where("NOT test"), size)).select("features", "label", "weight").persist()
    model = forest.setWeightCol("weight").fit(train)
    train.unpersist()
    test = model.transform(assembler.transform(cells.where("test")))
    mean = cells.where("test").agg((F.sum(F.col("n") * F.col("label")) / F.sum("n")).alias("m")).first()["m"]
    around = lambda middle: F.sum(F.col("n") * (F.col("spread") + F.pow(F.col("label") - middle, 2)))
    errors = test.agg(around(F.col("prediction")).alias("left"), around(F.lit(mean)).alias("all")).first()
    r2 = 1 - errors["left"] / errors["all"] if errors["all"] else float("nan")
    by_name = bins_of({c: edges[n] for c, n in zip(drivers, names)}, {c: c for c in drivers})
    features = VectorAssembler(inputCols=by_name.getOutputCols(), outputCol="features")
    return PipelineModel(stages=[by_name, features, model]), r2


def driver_model(
    df: DataFrame, outcome: str, drivers: Sequence[str], trees: int = 100, depth: int = 5, seed: int = 42
) -> tuple[RandomForestRegressionModel | PipelineModel, DataFrame]:
    """Fitted forest and its report: feature, importance, r2 on a 20% holdout.

    Over FOREST_ROWS rows the forest is fitted on weighted cells, as in :func:`forest_classify`,
    and the model is a pipeline from the drivers' bins. The r2 is that of all holdout rows.
    """
    rows = complete_rows(df.select(*[quoted(c) for c in [outcome, *drivers]]), [outcome, *drivers])
    forest = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed)
    if (size := rows.count()) > FOREST_ROWS:
        model, r2 = _regress_cells(rows, size, outcome, drivers, forest, seed)
        importances = model.stages[-1].featureImportances
    else:
        data = VectorAssembler(inputCols=list(drivers), outputCol="features").transform(rows)
        data = data.select("features", quoted(outcome).alias("label")).persist()
        train, test = data.randomSplit([0.8, 0.2], seed=seed)
        model = forest.fit(train)
        r2 = RegressionEvaluator(metricName="r2").evaluate(model.transform(test))
        importances = model.featureImportances
        data.unpersist()
    report = df.sparkSession.createDataFrame(
        [(c, float(v), float(r2)) for c, v in zip(drivers, importances.toArray())],
        "feature string, importance double, r2 double",
    )
    return model, report.orderBy(F.desc("importance"), "feature")


def _scored_cells(rows: DataFrame, model: PipelineModel, drivers: Sequence[str], scenarios: Sequence[tuple]) -> DataFrame:
    """Predictions of all scenarios for cells of rows that agree in their bins, with the number of rows of each."""
    by_name, features, forest = model.stages
    edges = {c: by_name.getSplitsArray()[i][1:-1] for i, c in enumerate(by_name.getInputCols())}
    moved = {f"_s{i}": (d, factor) for i, (_, d, factor) in enumerate(scenarios) if d is not None}
    shifted = rows.withColumns({name: quoted(d) * F.lit(factor) for name, (d, factor) in moved.items()})
    placed = bins_of(edges, {**{c: c for c in drivers}, **{name: d for name, (d, _) in moved.items()}}).transform(shifted)
    bins = [*[f"{c}_bin" for c in drivers], *[f"{name}_bin" for name in moved]]
    cells = placed.groupBy(*[quoted(b) for b in bins]).agg(F.count(F.lit(1)).alias("n"))
    copies = F.array(
        *[
            F.struct(
                F.lit(kind).alias("change"), F.lit(driver).cast("string").alias("driver"), F.col("n").alias("n"),
                *[quoted(f"_s{i}_bin" if c == driver else f"{c}_bin").alias(f"{c}_bin") for c in drivers],
            )
            for i, (kind, driver, _) in enumerate(scenarios)
        ]
    )
    keys = ["change", "driver", *[f"{c}_bin" for c in drivers]]
    merged = cells.select(F.inline(copies)).groupBy(*[quoted(k) for k in keys]).agg(F.sum("n").alias("n"))
    return forest.transform(features.transform(merged))


def what_if(
    df: DataFrame, model: RandomForestRegressionModel, drivers: Sequence[str], pct: float = 0.1
) -> DataFrame:
    """Mean prediction when one driver rises or falls by ``pct``, as percent change of the base.

    All scenarios are scored in one pass: each row fans out to its perturbed copies and
    the predictions are averaged before anything is shuffled.
    """
    rows = complete_rows(df.select(*[quoted(c) for c in drivers]), drivers)
    scenarios = [("base", None, 1.0)]
    for d in drivers:
        scenarios += [("increase", d, 1 + pct), ("decrease", d, 1 - pct)]
    if isinstance(model, PipelineModel):
        scored = _scored_cells(rows, model, drivers, scenarios)
    else:
        copies = F.array(
            *[
                F.struct(
                    F.lit(kind).alias("change"), F.lit(driver).cast("string").alias("driver"),
                    *[(quoted(c) * F.lit(factor) if c == driver else quoted(c)).alias(c) for c in drivers],
                )
                for kind, driver, factor in scenarios
            ]
        )
        data = VectorAssembler(inputCols=list(drivers), outputCol="features").transform(rows.select(F.inline(copies)))
        scored = model.transform(data).withColumn("n", F.lit(1))
    mean = F.sum(F.col("n") * F.col("prediction")) / F.sum("n")
    means = scored.groupBy("change", "driver").agg(mean.alias("prediction"))
    wide = means.groupBy().agg(
        F.max(F.when(F.col("change") == "base", F.col("prediction"))).alias("base"),
        *[
            F.max(F.when((F.col("change") == kind) & (F.col("driver") == d), F.col("prediction"))).alias(f"{kind}_{i}")
            for i, d in enumerate(drivers) for kind in ("increase", "decrease")
        ],
    )
    effect = lambda c: (F.col(c) - F.col("base")) / F.abs(F.when(F.col("base") != 0, F.col("base"))) * 100
    cells = [
        F.struct(
            F.lit(d).alias("driver"), effect(f"increase_{i}").alias("increase_effect"),
            effect(f"decrease_{i}").alias("decrease_effect"), F.col("base").alias("base_prediction"),
        )
        for i, d in enumerate(drivers)
    ]
    return wide.select(F.inline(F.array(*cells)))


def label_drivers(effects: DataFrame, thr: float = 5.0) -> DataFrame:
    """Strong drivers (either effect at least ``thr`` percent) call for careful optimisation."""
    size = F.greatest(F.abs("increase_effect"), F.abs("decrease_effect"))
    return effects.withColumns(
        {
            "influence": F.when(size >= thr, "strong").otherwise("limited"),
            "advice": F.when(size >= thr, F.concat(F.lit("Carefully optimize "), "driver")).otherwise(
                F.concat("driver", F.lit(" shows limited measurable impact"))
            ),
        }
    )

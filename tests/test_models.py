from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidegate.config import Config, LoacoConfig, ModelConfig, PreprocessConfig
from tidegate.models import features as FE
from tidegate.models import isolation as IS
from tidegate.models import linear as LI
from tidegate.models import oneclass as OC
from tidegate.operators import cleaning as C
from tidegate.operators.metrics import roc_auc
from tidegate.plans import evaluate as EV
from tidegate.plans import preprocess as PP
from tidegate.plans import train as TR
from tidegate.session import scratch_path, stage
from tidegate.sinks.tables import write_prepared, write_splits, write_tables
from tidegate.sources.tables import read_split

SMALL = Config(
    preprocess=PreprocessConfig(rfe_features=10, class_cap=300),
    models=ModelConfig(forest_trees=10, forest_depth=6, one_class_iterations=6, isolation_trees=25, svc_max_iter=10),
    loaco=LoacoConfig(categories=("DoS", "Bot", "PortScan")),
)


@pytest.fixture(scope="module")
def prepared(spark):
    """Gaussian categories: benign at 0, attacks around shifted centres."""
    rng = np.random.default_rng(42)
    names = [f"f{i:02d}" for i in range(16)]
    parts = [pd.DataFrame(rng.normal(0, 1, (1200, 16)), columns=names).assign(Label="BENIGN")]
    for i, (label, n) in enumerate([("DoS Hulk", 250), ("DDoS", 150), ("Bot", 60)]):
        centre = np.zeros(16)
        centre[rng.choice(16, 6, replace=False)] = 3 + 0.5 * i
        parts.append(pd.DataFrame(rng.normal(centre, 1.2, (n, 16)), columns=names).assign(Label=label))
    df = spark.createDataFrame(pd.concat(parts, ignore_index=True)).withColumn("constant.1", F.lit(7.0))
    return C.normalise_labels(df.select(*names, F.col("`constant.1`"), "Label"))


@pytest.fixture(scope="module")
def splits(spark, prepared):
    table, pipeline = PP.preprocess(prepared, SMALL)
    path = scratch_path(spark, "splits")
    write_splits(table, path)
    return spark.read.parquet(path), pipeline, path


def test_splits(spark, splits):
    table, pipeline, path = splits
    assert "constant.1" not in pipeline.selected and len(pipeline.selected) == 10
    assert 0.95 < pipeline.explained_variance <= 1.0 and pipeline.n_components <= 10
    sizes = {r.category: r["count"] for r in read_split(spark, path, "train").groupBy("category").count().collect()}
    assert sizes == {"BENIGN": 300, "DoS": 300, "DDoS": 300, "Bot": 300}
    assert table.filter("split = 'test'").count() == 332 and table.filter("split = 'val'").count() == 166
    plan = read_split(spark, path, "val")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_pipeline_survives_storage_and_missing_inputs(spark, splits, prepared):
    _, pipeline, _ = splits
    path = scratch_path(spark, "pipeline")
    FE.save_pipeline(pipeline, path)
    loaded = FE.load_pipeline(spark, path)
    rows = prepared.limit(5)
    assert [r.features for r in loaded.transform(rows).collect()] == [r.features for r in pipeline.transform(rows).collect()]
    lacking = rows.drop(pipeline.selected[0])
    zeroed = rows.withColumn(pipeline.selected[0], F.lit(0.0))
    assert [r.features for r in pipeline.transform(lacking).collect()] == [r.features for r in pipeline.transform(zeroed).collect()]


def test_acceptance_limits(spark, splits):
    table, pipeline, _ = splits
    models = TR.train_all(table, SMALL)
    tables = EV.evaluate(table, models, SMALL)
    metrics = {r.model: r for r in tables["metrics_summary"].collect()}
    assert metrics["LinearSVC"].macro_f1 > 0.85 and metrics["Stack"].macro_f1 > 0.90
    assert metrics["Stack"].false_positive_rate < 0.05 and metrics["Stack"].ece < 0.10
    assert tables["per_category_recall"].columns == ["category", "IsolationForest", "LinearSVC", "Stack"]
    path = scratch_path(spark, "models")
    TR.save_models(models, spark, path)
    again = TR.load_models(spark, path)
    test = TR.part(table, "test").orderBy("row_id").limit(20)
    one = [r.p for r in TR.predictions(models, test).orderBy("model", "row_id").collect()]
    two = [r.p for r in TR.predictions(again, test).orderBy("model", "row_id").collect()]
    assert one == pytest.approx(two)
    stepped = replace(models.stack, anomaly=OC.calibrate(models.stack.anomaly, TR.part(table, "val"), "isotonic"))
    TR.save_models(replace(models, stack=stepped), spark, path)
    stored = TR.load_models(spark, path).stack
    assert stored.anomaly.method == "isotonic"
    three, four = ([r.p for r in m.transform(test).orderBy("row_id").collect()] for m in (stepped, stored))
    assert three == pytest.approx(four)
    scored = TR.scorer(pipeline, models.stack)(spark.createDataFrame([(0.0,)], "f00 double"))
    assert 0.0 <= scored.first().model_proba <= 1.0
    assert TR.training_summary(table, models).count() >= 6
    write_tables(tables, scratch_path(spark, "tables"), "csv")


def test_loaco(spark, splits):
    results = {r.held_out_category: r for r in EV.loaco(splits[0], SMALL).collect()}
    assert set(results) == {"DoS", "Bot"}
    assert all(0 <= r.novel_recall <= 1 and r.known_attack_recall > 0.8 for r in results.values())


def test_scaling_of_a_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in FE.standard_scale(df, ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_components_exceed_the_wanted_share():
    assert FE.components_for(np.array([0.5, 0.45, 0.05]), 0.95) in (2, 3)
    assert FE.components_for(np.array([0.5, 0.46, 0.04]), 0.95) == 2
    assert FE.components_for(np.array([0.6, 0.4]), 1.0) == 2


def test_newton_logistic_matches_a_reference_solution(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-(2 * x - 0.5)))).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    (weights, intercept), = LI.logistic_fits(df, [LI.LogisticTask(["x"], 1.0)])
    w, b = weights[0], intercept
    p = 1 / (1 + np.exp(-(w * x + b)))
    assert abs(((p - y) * x).sum() + w) < 1e-5 and abs((p - y).sum()) < 1e-5


def as_vectors(spark, x, y=None):
    pdf = pd.DataFrame({"row_id": np.arange(len(x)), "x": list(x), "y": np.zeros(len(x), int) if y is None else y})
    df = spark.createDataFrame(pdf, "row_id long, x array<double>, y int")
    return stage(df.select("row_id", array_to_vector("x").alias("features"), "y"), "vectors")


@pytest.fixture(scope="module")
def detector(spark):
    rng = np.random.default_rng(5)
    benign = rng.normal((4, 3), 1, (400, 2))
    return OC.fit_one_class(as_vectors(spark, benign), [0.1], 40)[0], benign


def test_one_class_bounds_the_benign_rows(detector):
    fitted, benign = detector
    outside = (benign @ np.array(fitted.weights) < fitted.rho).mean()
    assert 0.05 <= outside <= 0.12 and fitted.rho > 0


def test_calibration(spark, detector):
    fitted, benign = detector
    rows = as_vectors(spark, np.vstack([benign[:100], benign[:100] * -1]), np.r_[np.zeros(100, int), np.ones(100, int)])
    with pytest.raises(RuntimeError):
        fitted.transform(rows)
    with pytest.raises(ValueError):
        OC.calibrate(fitted, rows, "other")
    for method in ("sigmoid", "isotonic"):
        p = OC.calibrate(fitted, rows, method).transform(rows).select("y", "p")
        assert roc_auc(p, []).first().roc_auc > 0.99
        low, high = p.agg(F.min("p"), F.max("p")).first()
        assert low > 0 and high < 1


def test_isolation_forest(spark):
    rng = np.random.default_rng(2)
    forest = IS.fit_isolation_forest(as_vectors(spark, rng.normal(size=(600, 3))), 50, seed=1)
    assert forest.sample_size == 256 and forest.feature.shape == (50, 511)
    scored = IS.scale_scores(forest.transform(as_vectors(spark, np.vstack([np.zeros((1, 3)), np.full((1, 3), 9.0)]))))
    centre, far = scored.orderBy("row_id").collect()
    assert (centre.yhat, far.yhat) == (0, 1) and (centre.p, far.p) == (0.0, 1.0)
    flat = spark.createDataFrame([(0.4,), (0.4,)], "raw double")
    assert [r.p for r in IS.scale_scores(flat).collect()] == [0.0, 0.0]
    assert IS.average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_prepared_table_round_trip(spark, prepared):
    counts = write_prepared(prepared, scratch_path(spark, "prepared"))
    assert {r.Category: r.n for r in counts.collect()}["BENIGN"] == 1200


def test_registered_queries_use_the_library_settings(spark, monkeypatch):
    from tidegate.catalog import models as CM

    own, library = CM.SETTINGS, Config()
    assert (own.preprocess, own.loaco, own.data) == (library.preprocess, library.loaco, library.data)
    assert own.models == ModelConfig(forest_cv_rows=None)
    sf, asked = "/root/testdata/sf0.001", {}
    monkeypatch.setattr(EV, "loaco", lambda table, config: asked.update(loaco=config.loaco.categories))
    monkeypatch.setattr(FE, "fit_feature_pipeline", lambda rows, names, keep, variance: asked.update(keep=keep))
    CM._loaco(spark, sf)
    CM._pipeline(spark, sf)
    classes = {r.category for r in CM.vectors(spark, sf).select("category").distinct().collect()} - {"BENIGN"}
    assert len(classes) > 2 and set(asked["loaco"]) == classes and asked["keep"] == 30


def test_squared_hinge_reaches_the_minimum(spark):
    """Two fits in one run against plain gradient steps on the same rows, and one with a solution by hand."""
    from tidegate.models.squared_hinge import HingeTask, squared_hinge_fits

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(0, 1.5, 300) > 0.4).astype(int)
    fold = np.arange(300) % 3
    rows = spark.createDataFrame(
        [(int(f), int(t), [float(a) for a in v]) for f, t, v in zip(fold, y, x)], "fold int, y int, _x array<double>").repartition(5)
    tasks = [HingeTask((1.0, 1.0)), HingeTask((0.7, 1.9), 1, 0.5)]

    def loss(point, task):
        keep = np.ones(300, bool) if task.fold is None else fold != task.fold
        xs = np.concatenate([x, np.ones((300, 1))], 1)[keep]
        s = np.where(y[keep] > 0, 1.0, -1.0)
        w = task.c * np.where(s > 0, task.weights[1], task.weights[0])
        gap = np.maximum(0, 1 - s * (xs @ point))
        return 0.5 * point @ point + (w * gap ** 2).sum(), point - 2 * xs.T @ (w * gap * s)

    for fit, task in zip(squared_hinge_fits(rows, tasks, 4), tasks):
        value, gradient = loss(fit.point, task)
        assert fit.objective == pytest.approx(value, rel=1e-12) and np.abs(gradient).max() < 1e-5 and fit.steps < 30
        point = np.zeros(5)
        for _ in range(20_000):
            point = point - 1e-3 / 2 * loss(point, task)[1]
        assert value <= loss(point, task)[0] + 1e-9 and np.allclose(point, fit.point, atol=1e-4)
    # one row (x = 1, s = 1): v = 2 (1 - 2 v) for both entries, v = 2 / 5
    one, = squared_hinge_fits(spark.createDataFrame([(0, 1, [1.0])], "fold int, y int, _x array<double>"), [HingeTask((1.0, 1.0))], 1)
    assert one.point == pytest.approx([0.4, 0.4]) and one.objective == pytest.approx(0.16 + 0.04)


def test_fits_take_every_row(spark, monkeypatch):
    """More benign rows than the published samples have: 80,000 for the detector, 100,000 for the isolation forest."""
    from tidegate.models import stack as ST

    train = spark.range(100_700).select(
        F.col("id").alias("row_id"), array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), F.lit(0).alias("y"))
    rows = {}

    def isolation(benign, trees, sample_size, max_rows, seed):
        rows["isolation"] = IS.subsample_rows(benign, max_rows, seed, key=["row_id"]).count()

    monkeypatch.setattr(ST, "fit_one_class", lambda benign, *_: rows.update(one_class=benign.count()))
    monkeypatch.setattr(TR, "fit_linear_svc", lambda *_: None)
    monkeypatch.setattr(TR, "fit_isolation_forest", isolation)
    monkeypatch.setattr(TR, "fit_stack", lambda train, validation, config: ST.benign_detectors(train, config))
    TR.train_all(train.withColumn("split", F.lit("train")))
    assert rows == {"isolation": 100_700, "one_class": 100_700}
    forest = IS.fit_isolation_forest(train, 2, seed=1)
    assert forest.sample_size == 256 and forest.threshold.max() > 90_000


def test_loaco_rounds_share_their_passes(spark, splits):
    """The same as a stack for each category, and three categories take hardly more jobs than one."""
    from tidegate.models import stack as ST
    from tidegate.operators import metrics as M

    names, context = ["DoS", "DDoS", "Bot"], spark.sparkContext
    train, validation, test = (TR.part(splits[0], n) for n in ("train", "val", "test"))
    jobs, found = {}, {}
    for some in (names[:1], names):
        context.setJobGroup(f"loaco-{len(some)}", "rounds")
        config = replace(SMALL, loaco=LoacoConfig(categories=tuple(some)))
        found = {r.held_out_category: r for r in EV.loaco(splits[0], config).collect()}
        jobs[len(some)] = len(context.statusTracker().getJobIdsForGroup(f"loaco-{len(some)}"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert set(found) == set(names) and jobs[3] < 1.8 * jobs[1]
    scored = ST.leave_out_scores(train, validation, test, names, SMALL).toPandas()
    shared = ST.benign_detectors(train, SMALL)
    for name in names:
        model = ST.fit_stack(C.mask_category(train, name), C.mask_category(validation, name), SMALL, shared)
        alone = model.transform(test).withColumn("held_out_category", F.lit(name)).withColumn("yhat", (F.col("p") >= 0.5).cast("int"))
        together = scored[scored["held_out_category"] == name]["p"]
        assert np.allclose(np.sort(together), np.sort(alone.toPandas()["p"]), atol=1e-9)
        assert M.loaco_metrics(alone).first() == found[name]

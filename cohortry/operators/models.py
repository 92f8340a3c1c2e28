"""Feature matrices, tree models and their reports, on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import CountVectorizer, IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lift import hash_split

#: Classes of a target at most; one boosted model is fitted for each.
CLASSES = 100


def feature_matrix(profile: DataFrame, raw: DataFrame, kinds: list[str], target: str = "lead_submit") -> DataFrame:
    """One row per user of the profile: per kind counts, days, longest and summed dwell; diversity and totals; nulls are 0.

    One aggregation over the events (the kinds are given, so nothing is pivoted by a first pass).
    """
    used = raw.where(F.col("event_type") != target)
    a: list[Column] = []
    for k in kinds:
        hit = F.col("event_type") == k
        a += [
            F.count_if(hit).alias(f"{k}__count"),
            F.size(F.collect_set(F.when(hit, F.to_date("event_time")))).alias(f"{k}__days"),
            F.max(F.when(hit, F.col("dwell"))).alias(f"{k}__dur_max"),
            F.sum(F.when(hit, F.col("dwell"))).alias(f"{k}__dur_sum"),
        ]
    a += [F.size(F.collect_set("brand")).alias("n_brands"), F.size(F.collect_set("model")).alias("n_models"), F.size(F.collect_set("event_type")).alias("n_types"), F.count("*").alias("n_actions")]
    return profile.join(used.groupBy("user_id").agg(*a), "user_id", "left").fillna(0)


def event_flags(raw: DataFrame, kinds: list[str]) -> DataFrame:
    """One boolean column per kind of event; the kinds are given so that the pivot takes one pass."""
    return raw.groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1)) > 0).fillna(False, kinds)


def column_kinds(frame: DataFrame, columns: list[str], list_share: float = 0.3) -> DataFrame:
    """``(column, kind)``: numeric if every filled value reads as a number, list if over a share hold commas, else categorical; in one pass."""
    a = []
    for c in columns:
        v = F.col(c).cast("string")
        filled = v.isNotNull() & (F.trim(v) != "")
        a.append(F.struct(F.lit(c).alias("column"), F.count_if(filled).alias("n"), F.count_if(filled & v.try_cast("double").isNotNull()).alias("num"), F.count_if(filled & v.contains(",")).alias("lists")).alias(f"_{len(a)}"))
    rows = frame.agg(*a).select(F.explode(F.array(*[f"_{i}" for i in range(len(columns))])).alias("r")).select("r.*")
    kind = F.when(F.col("n") == 0, "empty").when(F.col("num") == F.col("n"), "numeric").when(F.col("lists") > list_share * F.col("n"), "list").otherwise("categorical")
    return rows.select("column", kind.alias("kind"))


def list_vocabulary(frame: DataFrame, column: str, top: int, sep: str = ",") -> DataFrame:
    """The ``top`` most frequent items of a list column, ties by item."""
    items = frame.select(F.explode(F.array_distinct(F.split(F.col(column), sep))).alias("item")).where(F.trim("item") != "")
    return items.groupBy(F.trim("item").alias("item")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(top)


def multi_hot(frame: DataFrame, column: str, vocabulary: list[str], sep: str = ",") -> DataFrame:
    items = F.transform(F.split(F.coalesce(F.col(column), F.lit("")), sep), lambda x: F.trim(x))
    return frame.withColumns({f"{column}__{v}": F.array_contains(items, v).cast("int") for v in vocabulary})


def feature_stages(numeric: list[str], categorical: list[str], lists: list[str], vocabulary: int = 50) -> list:
    """Stages that turn filled columns into ``features``: labels by alphabet with a place for unseen ones, lists as binary counts."""
    index = [StringIndexer(inputCol=c, outputCol=f"{c}__i", stringOrderType="alphabetAsc", handleInvalid="keep") for c in categorical]
    bags = [CountVectorizer(inputCol=f"{c}__a", outputCol=f"{c}__v", vocabSize=vocabulary, binary=True) for c in lists]
    return [*index, *bags, VectorAssembler(inputCols=[*numeric, *[f"{c}__i" for c in categorical], *[f"{c}__v" for c in lists]], outputCol="features", handleInvalid="keep")]


def prepared(frame: DataFrame, numeric: list[str], categorical: list[str], lists: list[str], sep: str = ",") -> DataFrame:
    """Numbers filled with 0, labels with a name for none, lists split."""
    n = {c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)) for c in numeric}
    k = {c: F.coalesce(F.col(c).cast("string"), F.lit("(none)")) for c in categorical}
    a = {f"{c}__a": F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "") for c in lists}
    return frame.withColumns(n | k | a | {"_class": F.lit(0.0)})


def train(frame: DataFrame, target: str, kind: str, numeric: list[str], categorical: list[str] = (), lists: list[str] = (), trees: int = 20, depth: int = 4, seed: int = 42, hold_out: float = 0.0, id_col: str | None = None) -> PipelineModel:
    """A boosted-tree pipeline for ``regression`` or ``binary``; for ``multi`` (classes 0, 1, ...) one of each class against the rest.

    Classes may be texts: their dictionary, in alphabetic order and of at most CLASSES, is kept with the model, and ``predict`` gives texts back.
    With ``hold_out`` that share of the rows, of each class, in the order of a digest of ``id_col``, is held out: boosting ends
    once a tree no longer lowers its error, and the model has the trees up to there (``trees_used``).
    """
    frame, named = frame.where(F.col(target).isNotNull()), []
    if kind != "regression" and dict(frame.dtypes)[target] == "string":
        names = [r[0] for r in frame.select(target).distinct().orderBy(target).limit(CLASSES + 1).collect()]
        if len(names) > CLASSES:
            raise ValueError(f"{target} has more than {CLASSES} classes")
        named = [IndexToString(inputCol="_class", outputCol="_class_name", labels=names)]
        number = F.array_position(F.array(*map(F.lit, names)), F.col(target)) - 1
    else:
        number = F.col(target)
    rows = prepared(frame, list(numeric), list(categorical), list(lists)).withColumn("label", number.cast("double"))
    early = {}
    if hold_out:
        if id_col is None:
            raise ValueError("rows are held out by a digest of id_col")
        by = F.lit(0) if kind == "regression" else F.col("label")
        rows = hash_split(rows.withColumn("_by", by), id_col, "_by", hold_out, "hold-out").withColumn("_held", F.col("split") == "val")
        early = {"validationIndicatorCol": "_held"}
    if kind == "regression":
        models = [GBTRegressor(labelCol="label", maxIter=trees, maxDepth=depth, seed=seed, **early)]
    elif kind == "binary":
        models = [GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, seed=seed, **early)]
    elif kind == "multi":
        classes = int(rows.agg(F.max("label")).first()[0] or 0) + 1
        rows = rows.withColumns({f"_is{k}": (F.col("label") == k).cast("double") for k in range(classes)})
        models = [
            GBTClassifier(labelCol=f"_is{k}", predictionCol=f"_hit{k}", maxIter=trees, maxDepth=depth, seed=seed, **early).setProbabilityCol(f"_prob{k}").setRawPredictionCol(f"_raw{k}")
            for k in range(classes)
        ]
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return Pipeline(stages=[*named, *feature_stages(list(numeric), list(categorical), list(lists)), *models]).fit(rows)


def trees_used(model: PipelineModel) -> list[int]:
    """The number of trees of each boosted model of a pipeline."""
    return [m.getNumTrees for m in model.stages if hasattr(m, "getNumTrees")]


def predict(model: PipelineModel, frame: DataFrame, kind: str, numeric: list[str], categorical: list[str] = (), lists: list[str] = ()) -> DataFrame:
    """``frame`` with ``xgb_prediction`` (clipped to 0-1 for regression), for two classes ``xgb_probability``, for more
    ``xgb_probabilities`` (of all classes, their sum is 1); text classes are told as texts; columns the frame lacks are empty.
    """
    missing = {c: F.lit(None).cast("string") for c in [*numeric, *categorical, *lists] if c not in frame.columns}
    out = model.transform(prepared(frame.withColumns(missing) if missing else frame, list(numeric), list(categorical), list(lists)))
    names = next((s.getLabels() for s in model.stages if isinstance(s, IndexToString)), None)

    def told(index: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int")) if names else index

    if kind == "regression":
        return out.select(*frame.columns, F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)).alias("xgb_prediction"))
    if kind == "binary":
        return out.select(*frame.columns, told(F.col("prediction")).alias("xgb_prediction"), vector_to_array("probability")[1].alias("xgb_probability"))
    own = [vector_to_array(m.getProbabilityCol())[1] for m in model.stages if m.hasParam("probabilityCol")]
    shares = out.select(*frame.columns, F.array(*own).alias("_own")).withColumn("_sum", F.aggregate("_own", F.lit(0.0), lambda a, x: a + x))
    best = (F.array_position("_own", F.array_max("_own")) - 1).cast("double")
    return shares.select(*frame.columns, told(best).alias("xgb_prediction"), F.transform("_own", lambda p: p / F.col("_sum")).alias("xgb_probabilities"))


def importances(model: PipelineModel, names: list[str], top: int = 10) -> list[tuple[str, float]]:
    """The ``top`` features of a tree model by importance; names in the order they were assembled."""
    v = model.stages[-1].featureImportances.toArray()
    return sorted(zip(names, map(float, v)), key=lambda x: (-x[1], x[0]))[:top]


def _running(counts: DataFrame, c: str, ranges: int = 256) -> DataFrame:
    """``counts(c, _n)`` with ``_upto``, the sum of ``_n`` up to each value; values are cut in ranges, so that no window holds them all."""
    cuts = counts.agg(F.percentile_approx(c, [i / ranges for i in range(1, ranges)])).first()[0] or []
    bounds = F.array(*[F.lit(x) for x in sorted(set(cuts))]).cast("array<double>")
    cut = counts.withColumn("_k", F.size(F.filter(bounds, lambda b: b < F.col(c))))
    sums = cut.groupBy(F.col("_k").alias("_range")).agg(F.sum("_n").alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = cut.withColumn("_within", F.sum("_n").over(W.partitionBy("_k").orderBy(c)))
    return within.join(F.broadcast(before), F.col("_k") == F.col("_range")).withColumn("_upto", F.col("_before") + F.col("_within")).select(*counts.columns, "_upto")


def regression_report(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """MAE, RMSE, R2, Pearson and Spearman of a frame of predictions."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    rank = scored.select(y.alias("y"), p.alias("p"))
    # Mean ranks by distinct value: ties share a rank.
    for c in ("y", "p"):
        n = rank.groupBy(c).agg(F.count("*").alias("_n"))
        r = _running(n, c).select(F.col(c).alias(f"_{c}"), (F.col("_upto") - (F.col("_n") - 1) / 2).alias(f"r{c}"))
        rank = rank.join(r, rank[c] == r[f"_{c}"])
    mean = scored.agg(F.avg(y).alias("m"))
    return (
        rank.join(F.broadcast(mean))
        .agg(
            F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"),
            F.sqrt(F.avg((F.col("y") - F.col("p")) ** 2)).alias("rmse"),
            (1 - F.sum((F.col("y") - F.col("p")) ** 2) / F.sum((F.col("y") - F.col("m")) ** 2)).alias("r2"),
            F.corr("y", "p").alias("pearson"),
            F.corr("ry", "rp").alias("spearman"),
        )
        .select(*[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2", "pearson", "spearman")])
    )


def confusion(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    return scored.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")).agg(F.count("*").alias("n"))


def classification_report(scored: DataFrame, label: str, prediction: str, scores: list[Column] | None = None) -> DataFrame:
    """Accuracy, macro and weighted F1 from the confusion counts; with ``scores`` (see ``auc_report``) the area too."""
    c = confusion(scored, label, prediction)
    per = (
        c.select("label", F.lit(0).alias("pred"), "n", F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp")).withColumnRenamed("label", "k")
        .unionAll(c.select(F.col("prediction").alias("k"), F.col("n").alias("pred"), F.lit(0).alias("n"), F.lit(0).alias("tp")))
        .groupBy("k").agg(F.sum("n").alias("n"), F.sum("pred").alias("pred"), F.sum("tp").alias("tp"))
    )
    f1 = F.when(F.col("n") + F.col("pred") > 0, 2 * F.col("tp") / (F.col("n") + F.col("pred"))).otherwise(0.0)
    report = per.withColumn("f1", f1).agg(
        F.round(F.sum("tp") / F.sum("n"), 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("n")) / F.sum("n"), 6).alias("weighted_f1")
    )
    return report.join(F.broadcast(auc_report(scored, label, scores))) if scores else report  # one row each


def auc_report(scored: DataFrame, label: str, scores: list[Column]) -> DataFrame:
    """One row ``auc``: the area under the ROC curve by mean ranks of the scores, ties sharing a rank.

    One score is that of class 1; of several the k-th is that of class k against the rest, and their areas are averaged
    (a class that is empty or holds all rows counts for nothing).
    """
    areas = None
    for k, score in enumerate(scores):
        hit = F.col(label) == (k if len(scores) > 1 else 1)
        n = scored.select(score.cast("double").alias("v"), hit.cast("long").alias("y")).groupBy("v").agg(F.count("*").alias("_n"), F.sum("y").alias("_pos"))
        p, total = F.sum("_pos"), F.sum("_n")
        area = F.try_divide(F.sum(F.col("_pos") * (F.col("_upto") - (F.col("_n") - 1) / 2)) - p * (p + 1) / 2, p * (total - p))
        one = _running(n, "v").agg(area.alias("area"))
        areas = one if areas is None else areas.unionAll(one)
    return areas.agg(F.round(F.avg("area"), 6).alias("auc"))


def k_fold(frame: DataFrame, target: str, kind: str, numeric: list[str], categorical: list[str] = (), lists: list[str] = (), folds: int = 5, id_col: str = "user_id", trees: int = 20, depth: int = 4) -> DataFrame:
    """``(fold, score)``: R2 (regression) or macro F1 (classes) on each fold of a model trained on the others.

    Folds go by a hash of the id, so they repeat.  ``frame`` is read several times for each fold: hand over a written one.
    """
    cut = frame.withColumn("_fold", F.pmod(F.xxhash64(id_col), F.lit(folds)))
    out = None
    for k in range(folds):
        model = train(cut.where(F.col("_fold") != k), target, kind, numeric, categorical, lists, trees, depth)
        guessed = predict(model, cut.where(F.col("_fold") == k), kind, numeric, categorical, lists)
        score = regression_report(guessed, target, "xgb_prediction").select(F.col("r2").alias("score")) if kind == "regression" else classification_report(guessed, target, "xgb_prediction").select(F.col("macro_f1").alias("score"))
        one = score.select(F.lit(k).alias("fold"), "score")
        out = one if out is None else out.unionAll(one)
    return out


def fold_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(F.count("score").alias("folds"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std"))


def auc(scored: DataFrame, label: str, score: str) -> float:
    return auc_report(scored, label, [F.col(score)]).first()["auc"]


def mined_paths(frame: DataFrame, features: list[str], label: str = "is_lead", depth: int = 6, least: int = 10) -> tuple[DecisionTreeClassifier, DataFrame]:
    """A balanced decision tree and ``frame`` with the leaf (path as text) each row falls into.

    The tree is walked once on the driver (at most 2^depth leaves); rows get their leaf by one expression.
    """
    n = {r["y"]: r["n"] for r in frame.groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    weight = F.lit(None)
    for y, k in n.items():
        weight = F.when(F.col(label) == y, total / (len(n) * k)).otherwise(weight)
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(frame.withColumn("_w", weight).withColumn("label", F.col(label).cast("double")))
    tree = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=least, weightCol="_w", seed=42).fit(rows)
    leaves: list[tuple[list[tuple[str, str, float]], float]] = []

    def walk(node, path):
        if node.numDescendants() == 0:
            leaves.append((path, node.prediction()))
            return
        s = node.split()
        f, t = features[s.featureIndex()], s.threshold()
        walk(node.leftChild(), [*path, (f, "<=", t)])
        walk(node.rightChild(), [*path, (f, ">", t)])

    walk(tree._call_java("rootNode"), [])
    leaf = F.lit(None).cast("string")
    for path, _ in leaves:
        hit = F.lit(True)
        for f, op, t in path:
            hit = hit & ((F.col(f) <= t) if op == "<=" else (F.col(f) > t))
        leaf = F.when(hit, F.lit(" AND ".join(f"{f} {op} {t:.4g}" for f, op, t in path) or "all")).otherwise(leaf)
    return tree, frame.withColumn("leaf", leaf)


def leaf_rules(with_leaf: DataFrame, label: str = "is_lead", least_tgi: float = 80) -> DataFrame:
    """Coverage, rate and lift of every leaf, those of at least ``least_tgi``."""
    base = with_leaf.agg(F.avg(label).alias("base"), F.count("*").alias("total"))
    g = with_leaf.groupBy("leaf").agg(F.count("*").alias("users"), F.avg(label).alias("rate")).join(F.broadcast(base))
    out = g.select("leaf", "users", F.round(F.col("users") / F.col("total"), 6).alias("coverage"), F.round("rate", 6).alias("lead_rate"), F.round(F.col("rate") / F.col("base") * 100, 4).alias("tgi"))
    return out.where(F.col("tgi") >= least_tgi)

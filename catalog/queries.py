"""Every operator as a query over the supplied tables or a view of them."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixtures import table
from plumbline.functions.columns import col
from plumbline.functions.frames import scratch_path
from plumbline.operators import (
    anomaly, cleaning, dataset, explain, explore, features, forests, insights, leaderboard, models, profile, quality, report, training,
)
from plumbline.operators.neighbours import knn_predict
from plumbline.plans import dates
from plumbline.sources import csv, files

Query = Callable[[SparkSession, str], DataFrame]


def _on(view: str, build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(table(spark, sf_dir, view))


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.select(*[F.round(col(c), digits).alias(c) if c in names else col(c) for c in df.columns])


def _sums(df: DataFrame, *names: str) -> DataFrame:
    """Results of sums as shown here: 12 significant digits from 1e8 on, as
    further digits depend on the order in which an engine adds up."""

    def shown(c: str):
        x = col(c)
        step = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 11)
        large = F.when(step > 1, F.round(x / step) * step).otherwise(F.round(x, 3))
        return F.when(F.abs(x) < 1e8, x).otherwise(large).alias(c)

    return df.select(*[shown(c) if c in names else col(c) for c in df.columns])


# -- sources --------------------------------------------------------------


def csv_roundtrip(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "roundtrip") + ".csv"
    csv.write_csv(df, path)
    return csv.read_csv(df.sparkSession, path)


def folder_of(kind: str):
    """A folder of files in which columns are missing, moved or narrower, read back as one table."""

    def build(df: DataFrame) -> DataFrame:
        path = scratch_path(df.sparkSession, f"folder-{kind}")
        few = df.where("o_orderkey % 2 = 0").select(F.col("o_custkey").cast("int").alias("o_custkey"), "o_orderkey", F.floor("o_totalprice").alias("o_totalprice"))
        rest = df.where("o_orderkey % 2 = 1").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
        for name, part in (("a", few), ("b", rest)):
            part.write.option("header", True).format(kind).save(f"{path}/{name}")
        return files.read_folder(df.sparkSession, path, kind).select("o_orderkey", F.col("o_custkey").cast("bigint").alias("o_custkey"), F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderstatus")

    return build


def version_rows(df: DataFrame) -> DataFrame:
    cleaned = cleaning.drop_duplicates(df)
    choices = {"cleaned": (cleaned, True), "original": (cleaned, False), "fallback": (None, True)}
    parts = [
        dataset.version_select(df, version, wanted).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("choice"), "rows")
        for name, (version, wanted) in choices.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# -- cleaning -------------------------------------------------------------


def cleaning_summary(df: DataFrame) -> DataFrame:
    return cleaning.apply_cleaning(df).summary()


def report_json(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "report")
    report.write_report(report.report_long(df), path)
    return df.sparkSession.read.schema(report.SCHEMA).json(path)


def cleaning_log(df: DataFrame) -> DataFrame:
    return cleaning.apply_cleaning(df, custom_column_strategies={"price": "drop"}).log()


# -- anomaly --------------------------------------------------------------


def scores(df: DataFrame) -> DataFrame:
    return anomaly.iforest_scores(df, ["id"])


# -- features -------------------------------------------------------------


def suggested(df: DataFrame, rule) -> list[str]:
    return [r["column"] for r in rule(df).select("column").collect()]


def log_feature(df: DataFrame) -> DataFrame:
    names = suggested(df, features.suggest_log)
    return _rounded(features.add_log(df, names), 6, *[f"{c}_log" for c in names]).select("id", *[f"{c}_log" for c in names])


def sqrt_feature(df: DataFrame) -> DataFrame:
    names = suggested(df, features.suggest_sqrt)
    return _rounded(features.add_sqrt(df, names), 6, *[f"{c}_sqrt" for c in names]).select("id", *[f"{c}_sqrt" for c in names])


def bin_feature(df: DataFrame) -> DataFrame:
    names = suggested(df, features.suggest_bins)
    return features.add_quartile_bin(df, names).select("id", *[f"{c}_bin" for c in names])


def z_feature(df: DataFrame) -> DataFrame:
    names = [c for c in suggested(df, features.suggest_zscore) if c != "id"]
    return _rounded(features.add_zscore(df, names), 4, *[f"{c}_z" for c in names]).select("id", *[f"{c}_z" for c in names])


def interaction_feature(df: DataFrame) -> DataFrame:
    """Long form, as the pairs depend on the data."""
    pairs = features.interaction_pairs(df)
    names = [f"{a}_x_{b}" for a, b in pairs]
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), col(n).alias("value")) for n in names])
    return features.add_interaction(df, pairs).select("l_orderkey", "l_linenumber", F.inline(cells))


def ratio_feature(df: DataFrame) -> DataFrame:
    pairs = features.ratio_pairs(df)
    names = [f"{a}_per_{b}" for a, b in pairs]
    return _rounded(features.add_ratio(df, pairs), 4, *names).select("l_orderkey", "l_linenumber", *names)


def encoded(df: DataFrame, kind: str) -> list[str]:
    return [r["column"] for r in features.suggest_encoding(df).where(F.col("type") == kind).collect()]


def binary_feature(df: DataFrame) -> DataFrame:
    names = encoded(df, "binary_encode")
    return features.add_binary(df, names).select("id", *[f"{c}_enc" for c in names])


def onehot_feature(df: DataFrame) -> DataFrame:
    wide = features.add_onehot(df, encoded(df, "onehot"))
    return wide.select("id", *[c for c in wide.columns if c.startswith(("market_", "const_text_"))])


def target_feature(df: DataFrame) -> DataFrame:
    name = encoded(df, "target_encode")[0]
    return _rounded(features.add_target_encoding(df, name, "bal"), 4, f"{name}_target").select("id", f"{name}_target")


def hash_feature(df: DataFrame) -> DataFrame:
    names = encoded(df, "hash_encode")
    return features.add_hash(df, names).select("id", *[f"{c}_hash" for c in names])


def date_feature(df: DataFrame) -> DataFrame:
    names = features.date_columns(df, df.columns)
    parts = [f"{c}_{p}" for c in names for p in ("year", "month", "weekday")]
    return features.add_date_parts(df, names).select("id", *parts)


def spelled_dates(df: DataFrame) -> DataFrame:
    """Parts of all text columns that are found to hold dates, however spelled, in long form."""
    texts = df.drop("day")
    names = features.date_columns(texts, ["id"])
    parts = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}_{p}").alias(p) for p in ("year", "month", "weekday")]) for c in names])
    return features.add_date_parts(texts, names).select("id", F.inline(parts))


def apply_features(df: DataFrame) -> DataFrame:
    """Transforms learned from the training rows, on the others."""
    rows = training.hash_split(df, ["id"])
    train, test = rows.where(~F.col("is_test")).drop("is_test"), rows.where("is_test").drop("is_test")
    found = features.add_zscore(train, ["bal"], test)
    found = features.add_binary(train, ["seg"], found)
    found = features.add_target_encoding(train, "nation", "bal", onto=found)
    return _rounded(found, 4, "bal_z", "nation_target").select("id", "bal_z", "seg_enc", "nation_target")


# -- models ---------------------------------------------------------------

KEY = ["k"]
CLASS, NUMBER = "y_txt", "y_num"


def _features(df: DataFrame, target: str) -> training.Features:
    other = NUMBER if target == CLASS else CLASS
    return training.prepare_features(df.drop(other), target, KEY)


def _one_feature(df: DataFrame) -> training.Features:
    return training.prepare_features(df.select("k", "q", NUMBER), NUMBER, KEY)


def encode_labels(df: DataFrame) -> DataFrame:
    return training.label_encode(df.select("id", "priority", "status"), ["priority", "status"])


def impute(df: DataFrame) -> DataFrame:
    return training.impute_median(df.select("k", "q", "d"), ["q", "d"])


def target_rows(df: DataFrame) -> DataFrame:
    rows, classes = training.prepare_target(df, "priority", training.CLASSIFICATION)
    names = F.array(*[F.lit(c) for c in classes])
    return rows.select("id", F.col("label").cast("int").alias("label"), F.get(names, F.col("label").cast("int")).alias("class_name"))


def guard(df: DataFrame) -> DataFrame:
    enough = training.min_rows_guard(df)
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(enough).alias("enough"))


def fitted_metrics(name: str, *targets: str) -> Query:
    """Metrics of one candidate on the test rows, for each target."""

    def build(df: DataFrame) -> DataFrame:
        def board(target: str) -> DataFrame:
            run = leaderboard.train_candidates(_features(df, target), names=[name])
            return run.leaderboard.select(F.lit(target).alias("target"), "model", "status", "score", "accuracy", "f1_score", "rmse", "mae", "r2_score")

        # side by side: a boosted fit is hundreds of short jobs in a row, which leave most cores idle
        run = inheritable_thread_target(df.sparkSession)(board)
        with ThreadPoolExecutor(len(targets)) as pool:
            return reduce(DataFrame.unionByName, pool.map(run, targets))

    return _on("fx_ml", build)


def knn_rows(df: DataFrame) -> DataFrame:
    prepared = _features(df, CLASS)
    train, test = leaderboard.split(prepared, 0.2)
    found = knn_predict(train, test, prepared.names, KEY, prepared.task)
    return found.select("k", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


def linear_weights(name: str) -> Query:
    def build(df: DataFrame) -> DataFrame:
        prepared = _one_feature(df)
        train, _ = leaderboard.split(prepared, 0.2)
        return models.coefficients(models.fit(name, prepared, train), df.sparkSession)

    return _on("fx_ml", build)


def rule_classes(df: DataFrame) -> DataFrame:
    """A threshold on ``q`` as the prediction of ``y_txt``."""
    return df.select(F.col(CLASS).alias("label"), F.when(F.col("q") > 25, "hi").otherwise("lo").alias("prediction"))


def rule_numbers(df: DataFrame) -> DataFrame:
    """A line in ``q`` as the prediction of ``y_num``."""
    return df.select(F.col(NUMBER).alias("label"), (F.col("q") * 2 + 4).alias("prediction"))


def importance(df: DataFrame) -> DataFrame:
    prepared = _features(df, CLASS)
    train, _ = leaderboard.split(prepared, 0.2)
    return models.fit("Decision Tree", prepared, train).importance_frame(df.sparkSession)


def _linear_run(df: DataFrame) -> leaderboard.Trained:
    """Two linear models and one candidate that fails."""
    return leaderboard.train_candidates(_one_feature(df), names=["Ridge", "Lasso", "Unknown"])


BOARD = ("rank", "model", "status", "score", "rmse", "mae", "r2_score", "is_best")


def board_rows(df: DataFrame) -> DataFrame:
    return _linear_run(df).leaderboard.select(*BOARD)


def board_roundtrip(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "automl")
    leaderboard.save(_linear_run(df), path)
    return leaderboard.load_leaderboard(df.sparkSession, path).select(*BOARD)


def board_predict(df: DataFrame) -> DataFrame:
    """Raw rows through the kept preparation and the best model that was read back."""
    path = scratch_path(df.sparkSession, "automl")
    leaderboard.save(_linear_run(df), path)
    found = leaderboard.load_model(df.sparkSession, path).predict(df)
    return found.select("k", F.round("prediction", 3).alias("prediction"))


def full_board(df: DataFrame) -> DataFrame:
    run = leaderboard.automl(df.drop(NUMBER), CLASS, KEY)
    return run.leaderboard.select("rank", "model", "status", "score", "accuracy", "f1_score", "is_best", "train_time_sec")


def shapley(df: DataFrame) -> DataFrame:
    prepared = _features(df, NUMBER)
    train, test = leaderboard.split(prepared, 0.2)
    score = explain.linear_score({"q": 2.0, "d": 100.0, "flag": -3.0}, 5.0)
    return explain.shapley_values(test, train, prepared.names, KEY, score)


def shapley_model(df: DataFrame) -> DataFrame:
    prepared = _features(df, CLASS)
    train, test = leaderboard.split(prepared, 0.2)
    fitted = models.fit("Decision Tree", prepared, train)
    return explain.explain_or_importance(fitted, prepared.task, test, train, prepared.names, KEY)


def model_report(df: DataFrame) -> DataFrame:
    return leaderboard.report(leaderboard.train_model(df.drop(NUMBER), CLASS, KEY))


def model_summary(df: DataFrame) -> DataFrame:
    return _linear_run(df).summary()


def fallback(df: DataFrame) -> DataFrame:
    prepared = _features(df, CLASS)
    train, _ = leaderboard.split(prepared, 0.2)
    fitted = models.fit("Decision Tree", prepared, train)
    return explain.shapley_fallback(fitted, df.sparkSession, "asked for the stand-in")


# -- inputs whose results are known: a label that is a step in one column, and rows planted far out --


def step_board(df: DataFrame) -> DataFrame:
    """All models that can follow a step exactly, as classes and as numbers."""
    trees = ["Random Forest", "Extra Trees", "Gradient Boosting", "Decision Tree", "KNN"]
    boards = []
    for target, task, names in ((CLASS, training.CLASSIFICATION, [*trees, "Logistic Regression"]), (NUMBER, training.REGRESSION, trees)):
        prepared = training.prepare_features(df.select("k", "v", target), target, KEY, task)
        run = leaderboard.train_candidates(prepared, names=names)
        boards.append(run.leaderboard.select(F.lit(target).alias("target"), "rank", "model", "status", "score", "accuracy", "f1_score", "rmse", "mae", "r2_score", "is_best"))
    return reduce(DataFrame.unionByName, boards)


def step_classes(df: DataFrame) -> DataFrame:
    """Models of three classes that follow two steps exactly, and how sure they are of each class."""
    prepared = training.prepare_features(df, CLASS, KEY, training.CLASSIFICATION)
    train, test = leaderboard.split(prepared, 0.2)
    boards = []
    for name, model in (("boosting", forests.boosted_classes(train, prepared.names, 3, rounds=12)), ("extra trees", forests.extra_trees(train, prepared.names, prepared.task, 3))):
        found = model.predict(test).select("label", "prediction", "probability")
        total = F.aggregate("probability", F.lit(0.0), lambda a, b: a + b)
        boards.append(found.groupBy(F.col("label").cast("int").alias("class")).agg(
            F.count(F.lit(1)).alias("support"), F.count_if(F.col("label") == F.col("prediction")).alias("hits"),
            F.min(F.get("probability", F.col("label").cast("int")) > 0.5).alias("sure"), F.round(F.max(F.abs(total - 1)), 6).alias("rest"),
        ).select(F.lit(name).alias("model"), "*"))
    return boards[0].unionByName(boards[1])


def _step_tree(df: DataFrame):
    prepared = _features(df, CLASS)
    train, test = leaderboard.split(prepared, 0.2)
    return prepared, train, test, models.fit("Decision Tree", prepared, train)


def step_importance(df: DataFrame) -> DataFrame:
    return _step_tree(df)[3].importance_frame(df.sparkSession)


def step_shapley(df: DataFrame) -> DataFrame:
    prepared, train, test, fitted = _step_tree(df)
    return explain.explain_or_importance(fitted, prepared.task, test, train, prepared.names, KEY)


def step_fallback(df: DataFrame) -> DataFrame:
    """A model that fails while its scores are computed."""
    prepared, train, test, fitted = _step_tree(df)
    fitted.predict = lambda rows: rows.withColumn("prediction", F.raise_error(F.lit("fails while it runs")))
    found = explain.explain_or_importance(fitted, training.REGRESSION, test, train, prepared.names, KEY)
    return found.select("feature", "importance", F.col("warning").contains("fails while it runs").alias("warned"))


def far_summary(df: DataFrame) -> DataFrame:
    return anomaly.anomaly_summary(df, ["id"], scores(df))


def far_rows(df: DataFrame) -> DataFrame:
    return scores(df).select("id", "is_anomaly")


def build() -> dict[str, Query]:
    quality_view, corr, rules, outlier, ml = "fx_quality", "fx_corr", "fx_rules", "fx_outlier", "fx_ml"
    order = ["id", "price", "priority", "status", "spiky", "cust_text", "day_text"]
    single = {
        "csv_roundtrip": (quality_view, csv_roundtrip),
        **{f"{kind}_folder": ("orders", folder_of(kind)) for kind in ("parquet", "json", "csv")},
        "row_cap": ("orders", lambda d: csv.cap_rows(d, ["o_orderkey"], 10_000).select("o_orderkey", "o_custkey", "o_orderstatus")),
        "schema_roles": ("lineitem", lambda d: dataset.schema_roles(d).drop("pos")),
        "preview": ("orders", lambda d: dataset.preview(d.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"])),
        "dataset_summary": ("orders", dataset.dataset_summary),
        "report_long": (rules, lambda d: report.report_long(d, cleaned=cleaning.drop_duplicates(d))),
        "version_select": ("fx_dups", version_rows),
        "dtype_counts": ("lineitem", dataset.dtype_counts),
        "na_normalise": ("fx_nonfinite", lambda d: dataset.normalise_missing(d).select("id", "raw_text", F.col("v").isNull().alias("v_missing"))),
        "sanitize_nonfinite": ("fx_nonfinite", lambda d: dataset.sanitise_nonfinite(d).select("id", "v")),
        "missing_by_column": (quality_view, quality.missing_by_column),
        "quality_score": (quality_view, quality.quality_score),
        "duplicate_count": ("fx_dups", quality.duplicate_count),
        "iqr_outliers": (quality_view, quality.iqr_outliers),
        "validity": ("fx_code", quality.validity),
        "column_stats_numeric": (outlier, lambda d: _sums(quality.column_stats_numeric(d), "mean", "std")),
        "column_stats_wide": ("fx_wide", lambda d: _rounded(_sums(quality.column_stats_numeric(d), "mean"), 1, "std").drop("skewness", "kurtosis")),
        "column_stats_categorical": (rules, quality.column_stats_categorical),
        "quality_grade": (quality_view, quality.quality_grade),
        "suggest_missing": (quality_view, quality.suggest_missing),
        "suggest_duplicates": (quality_view, quality.suggest_duplicates),
        "suggest_outliers": (quality_view, quality.suggest_outliers),
        "attention_columns": (quality_view, quality.attention_columns),
        "fill_mean": (quality_view, lambda d: _rounded(cleaning.fill_missing(d, "mean"), 4, "price")),
        "fill_median": (outlier, lambda d: cleaning.fill_missing(d, "median")),
        "fill_mode": (quality_view, lambda d: cleaning.fill_missing(d, "mode")),
        "fill_auto": (outlier, lambda d: cleaning.fill_missing(d, "auto")),
        "drop_missing": (quality_view, lambda d: cleaning.fill_missing(d, "drop")),
        "fill_custom": (quality_view, lambda d: _rounded(cleaning.fill_missing(d, "none", {"price": "mean", "priority": "median", "status": "drop"}), 4, "price")),
        "drop_duplicates": ("fx_dups", cleaning.drop_duplicates),
        "clip_iqr": (outlier, lambda d: _rounded(cleaning.clip_outliers(d, "iqr"), 4, "value")),
        "clip_zscore": (outlier, lambda d: _rounded(cleaning.clip_outliers(d, "zscore"), 4, "value", "rare_flag")),
        "cleaning_log": (quality_view, cleaning_log),
        "clean_pipeline": (quality_view, lambda d: _rounded(cleaning.apply_cleaning(d).df, 4, "price", "spiky")),
        "cleaning_summary": (quality_view, cleaning_summary),
        "cleaning_suggestions": (quality_view, quality.cleaning_suggestions),
        "report_json": (quality_view, report_json),
        "profile_overview": (quality_view, profile.profile_overview),
        "data_bytes": (quality_view, profile.data_bytes),
        "profile_columns": (rules, profile.profile_columns),
        "profile_numeric": (outlier, lambda d: _sums(profile.profile_numeric(d), "mean", "std", "variance")),
        "profile_outliers": (outlier, profile.profile_outliers),
        "profile_signs": (corr, profile.profile_signs),
        "normality_shapiro": ("customer", lambda d: profile.normality_shapiro(d, ["c_custkey"])),
        "normality_jb": (outlier, lambda d: _sums(profile.normality_jb(d), "jb")),
        "numeric_sample": (outlier, lambda d: profile.numeric_sample(d, ["id"])),
        "category_top_k": (rules, profile.category_top_k),
        "category_summary": (rules, profile.category_summary),
        "category_entropy": (rules, profile.category_entropy),
        "correlation_matrix": (corr, profile.correlation_matrix),
        "high_correlation": (corr, profile.high_correlation),
        "skewness_bands": (rules, profile.skewness_bands),
        "missing_pattern": (quality_view, lambda d: profile.missing_pattern(d, order)),
        "column_search": (corr, lambda d: profile.column_search(d, "QUANT")),
        "histogram": (outlier, explore.histogram),
        "box_stats": (outlier, explore.box_stats),
        "top_correlated_pair": ("lineitem", explore.top_correlated_pair),
        "scatter_pair": ("fx_corr", lambda d: explore.scatter_pair(d.select("l_orderkey", "l_linenumber", "l_extendedprice", "net"), ["l_orderkey", "l_linenumber", "net"])),
        "missing_bar": (quality_view, explore.missing_bar),
        "category_bars": (rules, explore.category_bars),
        "insight_skewness": (rules, insights.insight_skewness),
        "insight_correlation": (corr, insights.insight_correlation),
        "insight_imbalance": (rules, insights.insight_imbalance),
        "insight_low_variance": (rules, insights.insight_low_variance),
        "insight_cardinality": (rules, insights.insight_cardinality),
        "insight_constant": (rules, insights.insight_constant),
        "insight_summary": (rules, insights.insight_summary),
        "insights_all": (rules, insights.insights_all),
        "insights_report": (corr, insights.insights_report),
        "impute_scale": (outlier, lambda d: anomaly.impute_scale(d, ["id"])),
        "iforest_draws": (outlier, lambda d: anomaly.forest_draws(d, ["id"]).select("tree", F.col("identity").cast("bigint").alias("id"), "draw")),
        "iforest_trees": (outlier, lambda d: anomaly.iforest_trees(d, ["id"])),
        "iforest_scores": (outlier, scores),
        "iqr_row_flags": (outlier, lambda d: anomaly.iqr_row_flags(d, ["id"])),
        "iqr_column_summary": (outlier, anomaly.iqr_column_summary),
        "zscore_flags": (outlier, lambda d: anomaly.zscore_flags(d, ["id"])),
        "anomaly_summary": (outlier, lambda d: anomaly.anomaly_summary(d, ["id"])),
        "iforest_summary": (outlier, lambda d: anomaly.iforest_summary(scores(d))),
        "iforest_flagged": (outlier, lambda d: anomaly.flagged_keys(scores(d), ["id"])),
        "anomaly_sample": (outlier, lambda d: anomaly.anomaly_sample(d, scores(d), ["id"])),
        "anomaly_series": (outlier, lambda d: anomaly.anomaly_series(scores(d), ["id"])),
        "feat_log": (rules, log_feature),
        "feat_sqrt": (rules, sqrt_feature),
        "feat_quartile_bin": (rules, bin_feature),
        "feat_zscore": (rules, z_feature),
        "feat_interaction": (corr, interaction_feature),
        "feat_ratio": (corr, ratio_feature),
        "feat_binary": (rules, binary_feature),
        "feat_onehot": (rules, onehot_feature),
        "feat_target_encode": (rules, target_feature),
        "feat_hash": (rules, hash_feature),
        "feat_datetime": (quality_view, date_feature),
        "feat_datetime_spellings": ("fx_dates", spelled_dates),
        "date_shapes": ("fx_dates", lambda d: dates.date_shapes(d, [c for c in d.columns if c not in ("id", "day")])),
        "feature_suggestions": (rules, lambda d: features.feature_suggestions(d, ["id"])),
        "suggestion_totals": (rules, lambda d: features.suggestion_totals(features.feature_suggestions(d, ["id"]))),
        "auto_features": (corr, lambda d: features.auto_features(features.feature_suggestions(d, ["l_orderkey"]))),
        "suggestion_filter": (rules, lambda d: features.suggestion_filter(features.feature_suggestions(d, ["id"]), "high", "SK")),
        "task_single": (ml, lambda d: training.task_frame(d, ["q", "d", "y_num", "y_txt"], training.task_single)),
        "task_automl": (ml, lambda d: training.task_frame(d, ["q", "d", "y_num", "y_txt"], training.task_automl)),
        "ml_keep_columns": (ml, lambda d: training.keep_columns(d, CLASS, KEY)),
        "label_encode": (quality_view, encode_labels),
        "ml_impute": (ml, impute),
        "target_prepare": (quality_view, target_rows),
        "min_rows_guard": (ml, guard),
        "hash_split": (ml, lambda d: training.hash_split(d, KEY).select("k", "is_test")),
        "model_knn": (ml, knn_rows),
        "metrics_classification": (ml, lambda d: training.metrics_classification(rule_classes(d))),
        "classification_report": (ml, lambda d: training.classification_report(rule_classes(d))),
        "metrics_regression": (ml, lambda d: training.metrics_regression(rule_numbers(d))),
        "feature_importance": (ml, importance),
        "leaderboard_rank": (ml, board_rows),
        "leaderboard_roundtrip": (ml, board_roundtrip),
        "leaderboard_predict": (ml, board_predict),
        "automl_leaderboard": (ml, full_board),
        "shapley_values": (ml, shapley),
        "shapley_global": (ml, lambda d: explain.shapley_global(shapley(d))),
        "shapley_points": (ml, lambda d: explain.shapley_points(shapley(d), KEY)),
        "shapley_row": (ml, lambda d: explain.shapley_row(shapley(d), KEY)),
        "shapley_model": (ml, shapley_model),
        "model_report": (ml, model_report),
        "leaderboard_summary": (ml, model_summary),
        "shapley_fallback": (ml, fallback),
        "feat_apply": (rules, apply_features),
        "step_leaderboard": ("fx_step", step_board),
        "step_classes": ("fx_step3", step_classes),
        "step_importance": ("fx_step", step_importance),
        "step_report": ("fx_step", lambda d: leaderboard.report(leaderboard.train_model(d.drop(NUMBER), CLASS, KEY))),
        "step_shapley": ("fx_step", step_shapley),
        "step_fallback": ("fx_step", step_fallback),
        "far_summary": ("fx_far", far_summary),
        "far_rows": ("fx_far", far_rows),
        "far_flagged": ("fx_far", lambda d: anomaly.flagged_keys(scores(d), ["id"])),
    }
    result = {name: _on(view, make) for name, (view, make) in single.items()}
    result["model_random_forest"] = fitted_metrics("Random Forest", CLASS, NUMBER)
    result["model_extra_trees"] = fitted_metrics("Extra Trees", CLASS, NUMBER)
    result["model_gbt"] = fitted_metrics("Gradient Boosting", CLASS, NUMBER)
    result["model_decision_tree"] = fitted_metrics("Decision Tree", CLASS, NUMBER)
    result["model_logistic"] = fitted_metrics("Logistic Regression", CLASS)
    result["model_ridge"] = linear_weights("Ridge")
    result["model_lasso"] = linear_weights("Lasso")
    return result

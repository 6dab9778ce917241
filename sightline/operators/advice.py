"""Machine-learning advice: target analysis, readiness scores, ranked algorithms, checks and tips."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.tablestats import TableStats, share, value_stats
from sightline.types import col, require, small_frame

CLASSIFICATION = ("classification", "binary classification")
ANOMALY = ("anomaly detection", "anomaly-detection")
TIME_SERIES = ("time series", "time-series", "timeseries")

# The algorithm catalogue.  Per entry: task, name, family, base score, complexity, training time,
# interpretability, the scores for accuracy, speed, interpretability and complexity, description, reasons,
# hyperparameters (JSON), and bonuses as (condition, points, reason or None).
CATALOGUE = [
    ("classification", "Random Forest", "Ensemble", 8.5, "Medium", "Medium", "High", (8, 7, 8, 6),
     "Ensemble method that combines multiple decision trees for robust predictions.",
     ["Handles mixed data types well", "Built-in feature importance", "Robust to outliers"],
     '{"n_estimators":[100,200,300],"max_depth":[10,20,null],"min_samples_split":[2,5,10]}',
     [("rows > 1000", 0.5, "Scales well with larger datasets"),
      ("categorical > 0", 0.5, "Naturally handles categorical features")]),
    ("classification", "Logistic Regression", "Linear", 7.0, "Low", "Fast", "Very High", (7, 9, 10, 3),
     "Linear model for classification that provides probability estimates.",
     ["Fast training and prediction", "Provides probability estimates", "Highly interpretable"],
     '{"C":[0.1,1,10],"penalty":["l1","l2"],"solver":["liblinear","saga"]}',
     [("features < 20", 1.0, "Works well with moderate feature count"),
      ("numeric > categorical", 0.5, "Performs well with primarily numerical features")]),
    ("classification", "Gradient Boosting (XGBoost)", "Ensemble", 8.0, "High", "Slow", "Medium", (9, 5, 6, 8),
     "Advanced boosting algorithm that often achieves state-of-the-art results.",
     ["High predictive accuracy", "Handles complex patterns", "Built-in feature selection"],
     '{"n_estimators":[100,200,500],"learning_rate":[0.01,0.1,0.2],"max_depth":[3,6,9]}',
     [("rows > 5000", 1.0, "Performs exceptionally well on large datasets")]),
    ("classification", "Support Vector Machine", "Kernel-based", 6.5, "Medium", "Medium", "Low", (7, 6, 4, 7),
     "Finds optimal decision boundary using support vectors.",
     ["Effective in high dimensions", "Memory efficient"],
     '{"C":[0.1,1,10],"kernel":["rbf","linear","poly"],"gamma":["scale","auto"]}',
     [("rows < 10000", 1.0, "Well-suited for smaller datasets"),
      ("features > rows", 1.0, "Handles high-dimensional data well")]),
    ("classification", "Naive Bayes", "Probabilistic", 6.0, "Low", "Very Fast", "High", (6, 10, 8, 2),
     "Simple probabilistic classifier based on feature independence assumption.",
     ["Very fast training", "Works well with small datasets", "Good baseline model"],
     '{"alpha":[0.1,1.0,10.0],"fit_prior":[true,false]}',
     [("categorical > numeric", 1.0, "Performs well with categorical features")]),
    ("regression", "Random Forest Regressor", "Ensemble", 8.0, "Medium", "Medium", "High", (8, 7, 8, 6),
     "Ensemble of decision trees for regression tasks.",
     ["Handles non-linear relationships", "Robust to outliers", "No assumptions about data distribution"],
     '{"n_estimators":[100,200,300],"max_depth":[10,20,null],"min_samples_split":[2,5,10]}',
     [("rows > 1000", 0.5, None)]),
    ("regression", "Linear Regression", "Linear", 7.0, "Low", "Very Fast", "Very High", (6, 10, 10, 2),
     "Linear relationship modeling between features and target.",
     ["Simple and interpretable", "Fast training", "Good baseline"],
     '{"fit_intercept":[true,false],"normalize":[true,false]}',
     [("features < 20", 1.0, "Works well with moderate feature count")]),
    ("regression", "Gradient Boosting Regressor", "Ensemble", 8.5, "High", "Slow", "Medium", (9, 5, 6, 8),
     "Sequential ensemble method that builds models to correct previous errors.",
     ["High accuracy", "Handles complex patterns", "Feature importance"],
     '{"n_estimators":[100,200,500],"learning_rate":[0.01,0.1,0.2],"max_depth":[3,6,9]}', []),
    ("regression", "Support Vector Regression", "Kernel-based", 6.5, "Medium", "Medium", "Low", (7, 6, 4, 7),
     "SVM adapted for regression tasks using epsilon-insensitive loss.",
     ["Effective in high dimensions", "Robust to outliers"],
     '{"C":[0.1,1,10],"kernel":["rbf","linear"],"gamma":["scale","auto"]}', [("rows < 10000", 1.0, None)]),
    ("clustering", "K-Means", "Centroid-based", 8.0, "Low", "Fast", "High", (7, 9, 9, 3),
     "Partitions data into k clusters by minimizing within-cluster sum of squares.",
     ["Simple and efficient", "Works well with spherical clusters", "Scalable"],
     '{"n_clusters":[2,3,5,8,10],"init":["k-means++","random"],"n_init":[10,20]}', []),
    ("clustering", "DBSCAN", "Density-based", 7.5, "Medium", "Medium", "Medium", (8, 7, 7, 6),
     "Groups together points in high-density areas and marks outliers.",
     ["Finds clusters of arbitrary shape", "Robust to outliers", "No need to specify cluster count"],
     '{"eps":[0.3,0.5,0.7,1.0],"min_samples":[3,5,10,15]}', []),
    ("anomaly detection", "Isolation Forest", "Tree-based", 8.0, "Low", "Fast", "Medium", (7, 9, 6, 3),
     "Detects anomalies by isolating observations.",
     ["Effective for high-dimensional data", "Scales well", "Works without labeled anomalies"],
     '{"n_estimators":[100,200],"contamination":[0.01,0.05,0.1]}', []),
    ("anomaly detection", "Local Outlier Factor", "Density-based", 7.5, "Medium", "Medium", "Low", (7, 6, 4, 6),
     "Identifies anomalies by comparing local density.",
     ["Captures local density variations", "Good for complex cluster structures"],
     '{"n_neighbors":[20,35,50],"contamination":[0.01,0.05,0.1]}', []),
    ("time series", "Gradient Boosting (with lag features)", "Ensemble", 7.5, "Medium", "Medium", "Medium",
     (8, 6, 6, 6), "Supervised model using generated lag/time features.",
     ["Flexible non-linear modeling", "Works with lag features", "Does not require strict stationarity"],
     '{"n_estimators":[200,500],"learning_rate":[0.05,0.1],"max_depth":[3,5]}', []),
    ("time series", "Random Forest (with lag features)", "Ensemble", 7.0, "Medium", "Medium", "Medium", (7, 6, 6, 6),
     "Tree ensemble using engineered lag features.",
     ["Robust to noise", "Captures non-linearities", "Less sensitive to feature scaling"],
     '{"n_estimators":[200,500],"max_depth":[10,20,null]}', []),
]

# Evaluation plan by task: metrics, validation method, folds, test share.
EVALUATION = {
    "classification": (["Accuracy", "Precision", "Recall", "F1-score", "ROC-AUC"],
                       "Stratified K-Fold Cross-Validation", 5, 0.2),
    "regression": (["MAE", "MSE", "RMSE", "R-squared"], "K-Fold Cross-Validation", 5, 0.2),
    "clustering": (["Silhouette Score", "Calinski-Harabasz Index", "Davies-Bouldin Index"], "Internal Validation",
                   None, None),
    "anomaly detection": (["Precision@k (if labels)", "Recall@k (if labels)", "PR-AUC (if labels)"],
                          "Unsupervised Evaluation / Manual Inspection", None, None),
    "time series": (["MAE", "RMSE", "MAPE"], "Temporal Train/Test Split", None, 0.2),
}


def _task_key(task: str) -> str:
    t = task.lower()
    for key, names in (("classification", CLASSIFICATION), ("anomaly detection", ANOMALY), ("time series", TIME_SERIES)):
        if t in names:
            return key
    return t


@dataclass
class TargetFacts:
    rows: int
    non_null: int
    unique: int
    rarest: int
    numeric: bool


def _target_facts(s: TableStats, target: str) -> TargetFacts:
    require(s.df, target)
    memo = s.__dict__.setdefault("_targets", {})
    if target not in memo:
        v = s.values[target] if target in s.strings and "values" in s.__dict__ else value_stats(s.df, [target])[target]
        memo[target] = TargetFacts(s.rows, s.non_null[target], v.unique, v.rarest, s.is_numeric(target))
    return memo[target]


def target_task(table, target: str) -> str:
    """The kind of learning task the target column asks for."""
    s = TableStats.of(table)
    f = _target_facts(s, target)
    if f.non_null == 0:
        return "Unknown"
    if f.numeric:
        few = f.unique <= 10 or f.unique / f.non_null < 0.05
        return "Classification" if few else "Regression"
    if f.unique == 2:
        return "Binary Classification"
    return "Classification" if f.unique <= 20 else "Text Classification"


def analyze_target(table, target: str) -> DataFrame:
    s = TableStats.of(table)
    f = _target_facts(s, target)
    return small_frame(s.spark, [(target, target_task(s, target), f.non_null, f.unique)],
                       "target string, task string, non_null_count bigint, unique_values bigint")


def _bounded(x: float) -> float:
    return float(max(0.0, min(10.0, x)))


def readiness_scores(table, target: str | None = None) -> dict[str, float]:
    """Six scores from 0 to 10."""
    s = TableStats.of(table)
    rows, width = s.rows, len(s.df.columns)
    out = {"completeness": _bounded(10 - 50.0 * (share(s.missing_cells, s.cells) or 0.0)),
           "size_adequacy": float(2 if rows < 100 else 5 if rows < 1000 else 8 if rows < 10000 else 10)}
    diversity = 3 if width < 3 else 6 if width < 10 else 9
    out["feature_diversity"] = _bounded(diversity + (1 if s.numeric and s.strings else 0))
    quality = max(0.0, 10 - 100.0 * (share(s.duplicates, rows) or 0.0))
    heavy = sum(1 for c in s.numeric if s.numbers[c].n and s.outliers[c] > 0.1 * s.numbers[c].n)
    out["data_quality"] = _bounded(quality - 0.5 * heavy)
    score = 7.0
    if target and target in s.df.columns:
        f = _target_facts(s, target)
        score = max(0.0, 10 - 50.0 * (share(rows - f.non_null, rows) or 0.0))
        if f.numeric and f.non_null and f.unique / f.non_null < 0.1:
            least = 100.0 * f.rarest / f.non_null
            score -= 2 if least < 5 else 1 if least < 15 else 0
    out["target_quality"] = _bounded(score)
    encoding = 10
    for c in s.strings:
        unique = s.values[c].unique
        encoding -= 1 if unique > 50 else 2 if unique == rows else 0
    out["encoding_readiness"] = _bounded(encoding)
    return out


def _status(score: float) -> str:
    return "Good" if score >= 7 else "Needs Work" if score >= 4 else "Poor"


def data_readiness(table, target: str | None = None) -> DataFrame:
    """The six scores, their mean as ``overall``, and a status each."""
    s = TableStats.of(table)
    scores = readiness_scores(s, target)
    scores["overall"] = sum(scores.values()) / len(scores)
    return small_frame(s.spark, [(k, v, _status(v)) for k, v in scores.items()],
                       "aspect string, score double, status string")


def readiness_status(scores: DataFrame, score: str = "score") -> DataFrame:
    """Status of any table of scores: from 7 Good, from 4 Needs Work, else Poor."""
    status = F.when(col(score) >= 7, "Good").when(col(score) >= 4, "Needs Work").otherwise("Poor")
    return scores.withColumn("status", status)


def suggest_algorithms(table, task: str, target: str | None = None) -> DataFrame:
    """Catalogue entries for the task, scored by rows, features and type mix, best first."""
    s = TableStats.of(table)
    facts = {"rows": s.rows, "features": len(s.df.columns) - (1 if target else 0), "numeric": len(s.numeric),
             "categorical": len(s.strings)}

    def holds(condition: str) -> bool:
        left, sign, right = condition.split()
        bound = facts[right] if right in facts else float(right)
        return facts[left] > bound if sign == ">" else facts[left] < bound

    rows = []
    for i, entry in enumerate(e for e in CATALOGUE if e[0] == _task_key(task)):
        _, name, family, score, complexity, time, readable, marks, text, reasons, params, bonuses = entry
        hit = [(points, reason) for condition, points, reason in bonuses if holds(condition)]
        rows.append((i, name, family, score + sum(p for p, _ in hit), complexity, time, readable, *map(float, marks),
                     text, reasons + [r for _, r in hit if r], params))
    rows.sort(key=lambda r: (-r[3], r[0]))
    return small_frame(s.spark, [(i + 1, *r[1:]) for i, r in enumerate(rows)], ALGORITHM_SCHEMA)


ALGORITHM_SCHEMA = ("position int, name string, family string, score double, complexity string, training_time string, "
                    "interpretability string, accuracy_potential double, speed_score double, "
                    "interpretability_score double, complexity_score double, description string, "
                    "reasons array<string>, hyperparameters string")


def compare_algorithms(algorithms: DataFrame, top: int = 5) -> DataFrame:
    """The best entries side by side."""
    return algorithms.orderBy("position").limit(top).select(
        "position", "name", "score", "complexity_score", "speed_score", "interpretability_score", "accuracy_potential")


ADVICE_SCHEMA = "topic string, reason string, level string, columns array<string>"


def _features(s: TableStats, target: str | None) -> list[str]:
    return [c for c in s.numeric if c != target]


def _feature_rows(s: TableStats, target: str | None) -> list[tuple]:
    rows = []
    missing = [c for c, k in s.nulls.items() if k]
    if missing:
        rows.append(("Missing Value Imputation", f"{len(missing)} columns have missing values", "High", missing))
    if s.strings:
        rows.append(("Categorical Encoding", f"{len(s.strings)} categorical columns need encoding", "High", s.strings))
    numeric = _features(s, target)
    if len(numeric) > 1:
        spans = [s.numbers[c].high - s.numbers[c].low for c in numeric[:5] if s.numbers[c].n]
        if spans and ((min(spans) == 0 and max(spans) > 0) or (min(spans) > 0 and max(spans) / min(spans) > 100)):
            rows.append(("Feature Scaling", "Features have very different scales", "Medium", numeric))
    heavy = [c for c in numeric if s.numbers[c].n and s.outliers[c] > 0.05 * s.numbers[c].n]
    if heavy:
        rows.append(("Outlier Treatment", f"{len(heavy)} columns have significant outliers", "Medium", heavy))
    return rows


def feature_engineering(table, target: str | None = None) -> DataFrame:
    s = TableStats.of(table)
    return small_frame(s.spark, _feature_rows(s, target), ADVICE_SCHEMA)


def _preprocessing_rows(s: TableStats, task: str, target: str | None) -> list[tuple]:
    rows = []
    if s.duplicates:
        rows.append(("Remove Duplicates", f"Remove {s.duplicates} duplicate rows", "High", s.df.columns))
    missing = [c for c, k in s.nulls.items() if k]
    if missing:
        rows.append(("Handle Missing Values", "Impute or remove missing values", "High", missing))
    if s.strings:
        rows.append(("Encode Categorical Variables", "Convert categorical variables to numerical format", "High",
                     s.strings))
    numeric = _features(s, target)
    if task.lower() in ("classification", "regression") and len(numeric) > 1:
        rows.append(("Scale Features", "Normalize or standardize numerical features", "Medium", numeric))
    return rows


def preprocessing_steps(table, task: str, target: str | None = None) -> DataFrame:
    s = TableStats.of(table)
    return small_frame(s.spark, _preprocessing_rows(s, task, target), ADVICE_SCHEMA)


def _evaluation_rows(task: str) -> list[tuple]:
    plan = EVALUATION.get(_task_key(task))
    return [plan] if plan else []


def evaluation_strategy(spark, task: str) -> DataFrame:
    return small_frame(spark, _evaluation_rows(task),
                       "metrics array<string>, validation_method string, cv_folds int, test_size double")


def _leak_rows(s: TableStats, target: str) -> list[tuple]:
    from sightline.functions.correlate import safe_corr
    from sightline.types import num
    require(s.df, target)
    word = target.lower()
    rows = [("name", c, None) for c in s.df.columns
            if c != target and (word in c.lower() or "leak" in c.lower() or "target" in c.lower())]
    others = [c for c in s.numeric if c != target]
    if target in s.numeric and others:
        row = s.df.agg(*[safe_corr(num(c), num(target)).alias(f"r{i}") for i, c in enumerate(others)]).first()
        rows += [("correlation", c, abs(row[f"r{i}"])) for i, c in enumerate(others)
                 if row[f"r{i}"] is not None and abs(row[f"r{i}"]) > 0.95]
    return rows


def leakage_check(table, target: str) -> DataFrame:
    """Columns that may give the target away: by name, or by a correlation above 0.95."""
    s = TableStats.of(table)
    return small_frame(s.spark, _leak_rows(s, target), "check string, column string, abs_correlation double")


def _tip_rows(s: TableStats, task: str, target: str | None, scores: dict[str, float]) -> list[tuple]:
    rows = []
    if s.rows > 100_000:
        rows += [("tip", "Consider using sampling for initial model development"),
                 ("tip", "Use algorithms that scale well with large datasets")]
    if len(s.df.columns) > 50:
        rows += [("tip", "Consider feature selection to reduce dimensionality"),
                 ("tip", "Use regularization to prevent overfitting")]
    if scores["data_quality"] < 7:
        rows.append(("tip", "Focus on data cleaning before model building"))
    if scores["completeness"] < 7:
        rows.append(("challenge", "High missing data rate may impact model performance"))
    if scores["size_adequacy"] < 5:
        rows.append(("challenge", "Small dataset size may limit model complexity"))
    if task.lower() in CLASSIFICATION and target:
        f = _target_facts(s, target)
        if f.unique > 1 and 100.0 * f.rarest / s.rows < 10:
            rows.append(("challenge", "Imbalanced target classes may require special handling"))
    return rows


def tips_and_challenges(table, task: str, target: str | None = None) -> DataFrame:
    s = TableStats.of(table)
    return small_frame(s.spark, _tip_rows(s, task, target, readiness_scores(s, target)), "kind string, text string")


def ml_recommendations(table, task: str | None = None, target: str | None = None) -> dict[str, DataFrame]:
    """All advice tables; without a task it is read off the target, without a target it is clustering."""
    s = TableStats.of(table)
    if task is None or task == "Auto-Detect":
        task = target_task(s, target) if target else "Clustering"
    out = {"task": small_frame(s.spark, [(task,)], "task string"), "data_readiness": data_readiness(s, target),
           "recommended_algorithms": suggest_algorithms(s, task, target),
           "feature_engineering": feature_engineering(s, target),
           "preprocessing_steps": preprocessing_steps(s, task, target),
           "evaluation_strategy": evaluation_strategy(s.spark, task),
           "tips_and_challenges": tips_and_challenges(s, task, target)}
    if target:
        out["leakage_warnings"] = leakage_check(s, target)
    return out


def recommendation_table(table, task: str | None = None, target: str | None = None) -> DataFrame:
    """The advice in long form: section, item, detail, score."""
    parts = ml_recommendations(table, task, target)
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    picks = {"task": (F.col("task"), text, none), "data_readiness": (F.col("aspect"), F.col("status"), F.col("score")),
             "recommended_algorithms": (F.col("name"), F.col("description"), F.col("score")),
             "feature_engineering": (F.col("topic"), F.col("reason"), none),
             "preprocessing_steps": (F.col("topic"), F.col("reason"), none),
             "evaluation_strategy": (F.col("validation_method"), F.array_join("metrics", ", "), F.col("test_size")),
             "tips_and_challenges": (F.col("kind"), F.col("text"), none),
             "leakage_warnings": (F.col("column"), F.col("check"), F.col("abs_correlation"))}
    out = None
    for section, frame in parts.items():
        item, detail, score = picks[section]
        part = frame.select(F.lit(section).alias("section"), item.alias("item"), detail.alias("detail"),
                            score.alias("score"))
        out = part if out is None else out.unionByName(part)
    return out

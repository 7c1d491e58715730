"""A small logistic candidate scorer: features, fit, scores and model guard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.functions.columns import all_of, finite
from trackframe.functions.lineage import cut_lineage
from trackframe.operators.matching import FRAME, match_points, score_band

# The scorer's feature names, in model order, and its version.
FEATURES = (
    "peak_snr_heuristic",
    "area_px",
    "elongation",
    "aperture_snr_heuristic",
    "raw_peak_fraction",
    "context_elongation",
    "context_area_px",
    "component_aspect",
    "local_noise_normalized",
    "local_contrast_normalized",
)
VERSION = "candidate-logistic-v1"
DETECTOR = "opencv_context_filtered_v2"


@dataclass(frozen=True)
class ScorerModel:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coef: tuple[float, ...]
    intercept: float
    features: tuple[str, ...] = FEATURES
    version: str = VERSION
    detector_name: str = DETECTOR


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def signed_log_features(candidates: DataFrame, names=FEATURES, evidence: str = "evidence") -> tuple[DataFrame, DataFrame]:
    """(rows with `features` array, rows whose evidence is missing or not finite)."""
    value = lambda n: F.col(evidence)[n]
    ok = F.coalesce(F.col(evidence).isNotNull() & all_of([finite(value(n)) for n in names]), F.lit(False))
    good = candidates.where(ok).withColumn("features", F.array(*[signed_log(value(n)) for n in names]))
    return good, candidates.where(~ok).withColumn("error", F.lit("missing_or_nonfinite_features"))


def feature_moments(rows: DataFrame, n: int = len(FEATURES), floor: float = 1e-8) -> DataFrame:
    """One row with mean and population std (floored) per feature."""
    f = lambda i: F.col("features")[i]
    return rows.agg(
        F.array(*[F.avg(f(i)) for i in range(n)]).alias("mean"),
        F.array(*[F.greatest(F.stddev_pop(f(i)), F.lit(floor)) for i in range(n)]).alias("scale"),
    )


def standardize(rows: DataFrame, moments: DataFrame) -> DataFrame:
    """(feature - mean) / scale with a one-row moments table."""
    m = moments.select(F.struct("mean", "scale")).scalar()
    z = F.zip_with(F.zip_with("features", "_m.mean", lambda x, c: x - c), "_m.scale", lambda x, c: x / c)
    return rows.withColumn("_m", m).withColumn("features", z).drop("_m")


def fit_logistic(rows: DataFrame, label: str = "label", max_iter: int = 200) -> ScorerModel:
    """Mean log-loss + 0.01 * |w|^2 with a free bias, over standardised features.

    Spark's L2 term is regParam / 2, so the regParam is 0.02.
    """
    rows = cut_lineage(rows)
    seen = rows.agg(F.count_distinct(label).alias("classes"), F.max(F.size("features")).alias("n")).first()
    if seen["classes"] != 2:
        raise ValueError("both classes are required")
    n = seen["n"]
    moments = feature_moments(rows, n)
    z = standardize(rows, moments).select(array_to_vector("features").alias("features"), F.col(label).cast("double").alias("label"))
    lr = LogisticRegression(regParam=0.02, elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-10)
    fit = lr.fit(z)
    m = moments.first()
    names = FEATURES if n == len(FEATURES) else tuple(f"f{i}" for i in range(n))
    return ScorerModel(tuple(m["mean"]), tuple(m["scale"]), tuple(float(c) for c in fit.coefficients), float(fit.intercept), names)


def model_problem(model: ScorerModel, features=FEATURES, version: str = VERSION, detector: str = DETECTOR) -> str | None:
    """Why a model cannot be used, or None. A bad model never fails a job."""
    import math

    if model.version != version or tuple(model.features) != tuple(features) or model.detector_name != detector:
        return "incompatible_model_version"
    vectors = (model.mean, model.scale, model.coef)
    if any(len(v) != len(features) or not all(math.isfinite(x) for x in v) for v in vectors):
        return "invalid_model_dimensions"
    if min(model.scale) <= 0 or not math.isfinite(model.intercept):
        return "invalid_model_scale"
    return None


def score(rows: DataFrame, model: ScorerModel) -> DataFrame:
    """Add `score` in (0, 1) and its band; expects signed-log `features`."""
    z = F.lit(float(model.intercept))
    for i, (m, s, c) in enumerate(zip(model.mean, model.scale, model.coef)):
        z = z + (F.col("features")[i] - m) / s * c
    z = F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0))
    return rows.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("category", score_band("score"))


def assess(candidates: DataFrame, model: ScorerModel, features=FEATURES, detector: str = DETECTOR) -> DataFrame:
    """Every candidate with score, band and status 'experimental' or 'unavailable'.

    A sequence is assessed only as a whole: one candidate from another detector or
    with unusable features makes its sequence unavailable, and so does a bad model.
    """
    none = {"score": F.lit(None).cast("double"), "category": F.lit(None).cast("string")}
    problem = model_problem(model, features, detector=detector)
    if problem:
        return candidates.withColumns({**none, "status": F.lit("unavailable"), "detail": F.lit(problem)})
    good, bad = signed_log_features(candidates, features)
    wrong = candidates.where(F.col("detector_name") != detector).select("sequence_id", F.lit("detector_not_compatible").alias("detail"))
    blocked = bad.select("sequence_id", F.lit("missing_or_nonfinite_features").alias("detail")).unionByName(wrong)
    blocked = blocked.groupBy("sequence_id").agg(F.min("detail").alias("detail"))
    scored = score(good, model).drop("features")
    usable = scored.join(blocked, "sequence_id", "left_anti").withColumns({"status": F.lit("experimental"), "detail": F.lit(None).cast("string")})
    rest = candidates.join(blocked, "sequence_id").withColumns({**none, "status": F.lit("unavailable")})
    return usable.unionByName(rest)


def training_labels(candidates: DataFrame, truth: DataFrame, gate: float = 5.0, **options) -> DataFrame:
    """Candidates with label 1 if the one-to-one matching pairs them, else 0."""
    pairs = match_points(candidates, truth, gate, **options).pairs.select(*FRAME, "detection_id", F.lit(1).alias("label"))
    return candidates.join(pairs, [*FRAME, "detection_id"], "left").na.fill(0, ["label"])

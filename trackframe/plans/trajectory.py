"""Queries: fits, forecasts and path views."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.operators import trajectory as r
from trackframe.plans import views as v
from trackframe.plans.registry import query


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def n6(*names):
    """Six digits of a fitted value. The offset, far below the last digit and the same
    in the SQL, keeps an exact half from being rounded by the noise of a long sum."""
    return [F.round(F.col(n) + 3e-8, 6).alias(n) for n in names]


def fit_cte(t: str, name: str = "fits") -> str:
    """Least squares by plain sums around the mean, independent of regr_* functions."""
    return f"""
    {name}_m AS (SELECT sequence_id, track_id, count(*) AS n, count(DISTINCT {t}) AS times, avg({t}) AS tm, avg(x_reference_px) AS xm,
        avg(y_reference_px) AS ym, min({t}) AS t0, max({t}) AS t1, min(frame_index) AS f0, max(frame_index) AS f1 FROM points GROUP BY ALL),
    {name}_s AS (SELECT m.*, s.vx, s.vy, xm + s.vx * (t0 - tm) AS x0, ym + s.vy * (t0 - tm) AS y0 FROM {name}_m m JOIN (
        SELECT sequence_id, track_id, sum(({t} - tm) * (x_reference_px - xm)) / sum(({t} - tm) * ({t} - tm)) AS vx,
          sum(({t} - tm) * (y_reference_px - ym)) / sum(({t} - tm) * ({t} - tm)) AS vy
        FROM points JOIN {name}_m USING (sequence_id, track_id) WHERE n >= 3 AND times >= 3 GROUP BY ALL) s USING (sequence_id, track_id)),
    {name} AS (SELECT s.*, e.rmse FROM {name}_s s JOIN (SELECT sequence_id, track_id,
          sqrt(avg((x_reference_px - x0 - vx * ({t} - t0)) * (x_reference_px - x0 - vx * ({t} - t0))
            + (y_reference_px - y0 - vy * ({t} - t0)) * (y_reference_px - y0 - vy * ({t} - t0)))) AS rmse
        FROM points JOIN {name}_s USING (sequence_id, track_id) GROUP BY ALL) e USING (sequence_id, track_id))"""


FIT_COLUMNS = """sequence_id, track_id, round(vx + 3e-8, 6) + 0.0::DOUBLE AS vx, round(vy + 3e-8, 6) + 0.0::DOUBLE AS vy, round(sqrt(vx * vx + vy * vy) + 3e-8, 6) AS speed, round(rmse + 3e-8, 6) AS fit_rmse_px,
    n AS observations_used, CAST(t0 AS DOUBLE) AS reference_epoch, round(x0 + 3e-8, 6) + 0.0::DOUBLE AS x_at_epoch_px, round(y0 + 3e-8, 6) + 0.0::DOUBLE AS y_at_epoch_px FROM fits"""


def fit_rows(fits):
    return fits.where("status = 'fitted'").select(
        "sequence_id", "track_id", *n6("vx", "vy", "speed", "fit_rmse_px"), "observations_used", "reference_epoch", *n6("x_at_epoch_px", "y_at_epoch_px")
    )


@query("fit_velocity_frames", v.sql("points", f"SELECT {FIT_COLUMNS}", fit_cte("frame_index")))
def _(spark, d):
    return fit_rows(r.fit_velocity(v.points(spark, d)))


@query("fit_velocity_seconds", v.sql("points", f"SELECT {FIT_COLUMNS}", fit_cte("timestamp_s")))
def _(spark, d):
    return fit_rows(r.fit_velocity(v.points(spark, d), "second"))


FORECAST = """forecast AS (SELECT sequence_id, track_id, h AS step, f1 + h AS frame_index, x0 + vx * (f1 + h - t0) AS x, y0 + vy * (f1 + h - t0) AS y
    FROM fits CROSS JOIN (SELECT unnest([1, 2]) AS h))"""


@query("extrapolate_frames", v.sql("points", f"""
    SELECT sequence_id, track_id, step, frame_index, round(x + 3e-8, 6) + 0.0::DOUBLE AS x_reference_px, round(y + 3e-8, 6) + 0.0::DOUBLE AS y_reference_px,
      NOT (x >= 0 AND x < {v.WIDTH} AND y >= 0 AND y < {v.HEIGHT}) AS out_of_field FROM forecast""", fit_cte("frame_index") + "," + FORECAST))
def _(spark, d):
    f = r.extrapolate(r.fit_velocity(v.points(spark, d)), 2, width=v.WIDTH, height=v.HEIGHT)
    return f.select("sequence_id", "track_id", "step", "frame_index", *n6("x_reference_px", "y_reference_px"), "out_of_field")


@query("extrapolate_seconds", v.sql("points frames", """
    SELECT f.sequence_id, f.track_id, f.h AS step, f.f1 + h AS frame_index, round(coalesce(k.timestamp_s, guess), 6) AS timestamp_s,
      round(x0 + vx * (coalesce(k.timestamp_s, guess) - t0) + 3e-8, 6) + 0.0::DOUBLE AS x_reference_px
    FROM (SELECT *, t1 + h * (t1 - t0) / (f1 - f0) AS guess FROM fits CROSS JOIN (SELECT unnest([1, 2]) AS h)) f
    LEFT JOIN frames k ON k.sequence_id = f.sequence_id AND k.frame_index = f.f1 + h""", fit_cte("timestamp_s")))
def _(spark, d):
    f = r.extrapolate(r.fit_velocity(v.points(spark, d), "second"), 2, v.frames(spark, d))
    return f.select("sequence_id", "track_id", "step", "frame_index", *r6("timestamp_s"), *n6("x_reference_px"))


@query("attach_trajectories", v.sql("tracks", """
    SELECT t.sequence_id, t.track_id, t.status, t.observed_count, round(f.vx + 3e-8, 6) + 0.0::DOUBLE AS vx, round(f.rmse + 3e-8, 6) AS fit_rmse_px
    FROM tracks t LEFT JOIN fits f USING (sequence_id, track_id)""", fit_cte("frame_index")))
def _(spark, d):
    a = r.attach_trajectories(v.tracks(spark, d), r.fit_velocity(v.points(spark, d)))
    return a.select("sequence_id", "track_id", "status", "observed_count", *n6("vx", "fit_rmse_px"))


HALVES = """early AS (SELECT * FROM points WHERE frame_index < 15)"""


@query("forecast_error", v.sql("points", """
    SELECT CAST(step AS INTEGER) AS step, count(*) AS forecasts, round(sqrt(avg(ev)), 6) AS velocity_rmse_px, round(sqrt(avg(eh)), 6) AS hold_rmse_px,
      round((sqrt(avg(eh)) - sqrt(avg(ev))) / sqrt(avg(eh)) * 100, 6) AS reduction_percent FROM (
      SELECT h AS step, (x0 + vx * (f1 + h - t0) - a.x_reference_px) ** 2 + (y0 + vy * (f1 + h - t0) - a.y_reference_px) ** 2 AS ev,
        (l.x_reference_px - a.x_reference_px) ** 2 + (l.y_reference_px - a.y_reference_px) ** 2 AS eh
      FROM fits f CROSS JOIN (SELECT unnest([1, 2]) AS h) JOIN all_points l ON l.sequence_id = f.sequence_id AND l.track_id = f.track_id AND l.frame_index = f.f1
      JOIN all_points a ON a.sequence_id = f.sequence_id AND a.track_id = f.track_id AND a.frame_index = f.f1 + h) GROUP BY step""",
    "all_points AS (SELECT * FROM points), " + fit_cte("frame_index").replace("FROM points", "FROM (SELECT * FROM all_points WHERE frame_index < 15) points")))
def _(spark, d):
    # Fitted on the first half of the month, checked against what came next.
    p = v.points(spark, d)
    early = p.where("frame_index < 15")
    e = r.forecast_error(r.extrapolate(r.fit_velocity(early)), r.zero_order_forecast(early), p)
    return e.select("step", "forecasts", *r6("velocity_rmse_px", "hold_rmse_px", "reduction_percent"))


@query("displacement_direction", v.sql("points", """
    SELECT sequence_id, track_id, round(dx, 6) AS dx_px, round(dy, 6) AS dy_px, CASE WHEN n < 2 THEN 'Insufficient observations'
      WHEN sqrt(dx * dx + dy * dy) < 1e-6 THEN 'No net displacement'
      ELSE ['right', 'lower right', 'down', 'lower left', 'left', 'upper left', 'up', 'upper right'][
        CAST((floor(atan2(dy, dx) / (pi() / 4) + 0.5) + 8) AS BIGINT) % 8 + 1] END AS direction
    FROM (SELECT sequence_id, track_id, count(*) AS n,
      CASE WHEN count(*) > 1 THEN arg_max(x_reference_px, frame_index) - arg_min(x_reference_px, frame_index) END AS dx,
      CASE WHEN count(*) > 1 THEN arg_max(y_reference_px, frame_index) - arg_min(y_reference_px, frame_index) END AS dy FROM points GROUP BY ALL)"""))
def _(spark, d):
    return r.displacement_direction(v.points(spark, d)).select("sequence_id", "track_id", *r6("dx_px", "dy_px"), "direction")


@query("missing_frames", v.sql("points frames", """
    SELECT t.sequence_id, t.track_id, f.frame_index FROM (SELECT DISTINCT sequence_id, track_id FROM points) t JOIN frames f USING (sequence_id)
    WHERE NOT EXISTS (SELECT 1 FROM points p WHERE p.sequence_id = t.sequence_id AND p.track_id = t.track_id AND p.frame_index = f.frame_index)"""))
def _(spark, d):
    return r.missing_frames(v.points(spark, d), v.frames(spark, d)).select("sequence_id", "track_id", "frame_index")


@query("visible_as_of", v.sql("points ids", """
    SELECT a.as_of_frame, p.sequence_id, p.track_id, p.frame_index, 'observed' AS point_type FROM points p JOIN as_of_ids a USING (sequence_id)
      WHERE p.frame_index <= a.as_of_frame
    UNION ALL SELECT a.as_of_frame, f.sequence_id, f.track_id, f.frame_index, 'extrapolated' FROM forecast f JOIN as_of_ids a USING (sequence_id)
      WHERE a.as_of_frame >= f.frame_index - f.step""",
    "as_of_ids AS (SELECT sequence_id, CAST(10 + user_id % 20 AS INTEGER) AS as_of_frame FROM ids)," + fit_cte("frame_index") + "," + FORECAST))
def _(spark, d):
    p = v.points(spark, d)
    ids = v.read(spark, d, "events").select("user_id").distinct()
    as_of = ids.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sequence_id"), (F.col("user_id") % 20 + 10).cast("int").alias("as_of_frame"))
    out = r.visible_as_of(p, r.extrapolate(r.fit_velocity(p)), as_of)
    return out.select("as_of_frame", "sequence_id", "track_id", "frame_index", "point_type")


@query("path_segments", v.sql("points", """
    SELECT * FROM (SELECT sequence_id, track_id, lag(frame_index) OVER w AS from_frame, frame_index AS to_frame,
      round(lag(x_reference_px) OVER w, 6) AS x0, round(lag(y_reference_px) OVER w, 6) AS y0, round(x_reference_px, 6) AS x1, round(y_reference_px, 6) AS y1
      FROM points WINDOW w AS (PARTITION BY sequence_id, track_id ORDER BY frame_index)) WHERE from_frame IS NOT NULL"""))
def _(spark, d):
    return r.path_segments(v.points(spark, d)).select("sequence_id", "track_id", "from_frame", "to_frame", *r6("x0", "y0", "x1", "y1"))


SUPPORTED = """supported AS (SELECT t.sequence_id, t.track_id, t.observed_count >= 3 AND s.span >= 2 AND t.quality_score >= 0.5 AND f.rmse IS NOT NULL AND f.rmse <= LIMIT_PX AS supported,
      s.span FROM tracks t JOIN (SELECT sequence_id, track_id, sqrt((max(x_reference_px) - min(x_reference_px)) ** 2 + (max(y_reference_px) - min(y_reference_px)) ** 2) AS span
      FROM points GROUP BY ALL) s USING (sequence_id, track_id) LEFT JOIN fits f USING (sequence_id, track_id))"""


@query("supported_motion", v.sql("tracks", """
    SELECT sequence_id, track_id, round(span, 6) AS span_px, coalesce(supported, false) AS supported FROM supported""",
    fit_cte("frame_index") + "," + SUPPORTED.replace("LIMIT_PX", "3")))
def _(spark, d):
    p = v.points(spark, d)
    s = r.supported_motion(p, v.tracks(spark, d), r.fit_velocity(p))
    return s.select("sequence_id", "track_id", *r6("span_px"), "supported")

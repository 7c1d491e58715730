from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.functions.stepper import TrackerConfig
from trackframe.operators import evaluation as ev
from trackframe.operators import matching, sweeps, tracking
from trackframe.plans import views


def test_sweep_rows_equal_single_runs(spark, sf):
    d = views.detections(spark, sf).withColumnsRenamed({"x": "x_raw_px", "y": "y_raw_px"})
    f = views.frames(spark, sf).select("sequence_id", "frame_index")
    truth = views.truth(spark, sf)
    configs = (TrackerConfig("wide", 40.0, 3, 2), TrackerConfig("strict", 20.0, 4, 1))
    got = {r.config_id: r for r in sweeps.tracking_sweep(d, f, truth, configs, sequences_are_small=True).collect()}
    for c in configs:
        steps = tracking.track_sequences(d, f, (c,), sequences_are_small=True).persist()
        p, t = tracking.points_of(steps), tracking.tracks_of(steps)
        m = ev.track_metrics(p, t, truth).agg(*[F.sum(n) for n in ("id_switches", "false_confirmed_tracks", "total_tracks")]).first()
        acc = tracking.accepted_observations(p, t, ["sequence_id", "track_id"], c.confirmation_observations)
        a = ev.detection_metrics(acc.withColumns({"x": F.col("x_raw_px"), "y": F.col("y_raw_px")}), truth).first()
        r = got[c.config_id]
        assert (r.tp, r.fp, r.fn) == (a.tp, a.fp, a.fn)
        assert (r.id_switches, r.false_confirmed_tracks, r.total_tracks) == tuple(m)


def test_sweep_stores_a_row_per_detection(spark, sf, monkeypatch):
    """Nine settings: what is stored has one row per detection or pair, and unfolds to the steps; the gate is searched once."""
    stored, gates = [], []
    monkeypatch.setattr(sweeps, "cut_lineage", lambda df: (stored.append(df), df)[1])
    monkeypatch.setattr("trackframe.operators.matching.gate_cells", lambda *a, f=matching.gate_cells, **o: (gates.append(a), f(*a, **o))[1])
    d = views.detections(spark, sf).withColumnsRenamed({"x": "x_raw_px", "y": "y_raw_px"})
    f = views.frames(spark, sf).select("sequence_id", "frame_index")
    sweeps.tracking_sweep(d, f, views.truth(spark, sf), sequences_are_small=True)
    assert len(gates) == 1 and stored[0].count() == d.count() > 0
    steps = tracking.track_sequences(d, f, sweeps.SWEEP, sequences_are_small=True)
    names = ["config_id", "sequence_id", "frame_index", "detection_id", "track_no", "status"]
    limits = {c.config_id: c.confirmation_observations for c in sweeps.SWEEP}
    got = tracking.unfold_configs(stored[0], sweeps.SWEEP).select(*names, "observed_count", "first").collect()
    want = steps.select(*names, "observed_count", F.col("obs_no") == 1).collect()
    assert sorted(map(tuple, got)) == sorted((*r[:6], min(r[6], limits[r[0]]), r[7]) for r in want)
    rows = lambda folded: tracking.accepted_observations(tracking.unfold_configs(folded, sweeps.SWEEP).withColumn("k", F.when(F.col("config_id").startswith("C2"), 4).when(F.col("config_id").startswith("C3"), 5).otherwise(3)), None, ["sequence_id"], "k")
    kept, every = [sorted(map(tuple, rows(x).select(*names).collect())) for x in (tracking.fold_accepted(stored[0], sweeps.SWEEP), stored[0])]
    assert kept == every and 0 < len(kept) < len(got)

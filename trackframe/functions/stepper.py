"""One sequence, one frame at a time: predict, associate, update the lifecycle.

The same step serves the batch job and the stream. It holds the tracks that are still
active with their observations; the stream keeps the last observation only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from trackframe.functions.assignment import solve


@dataclass(frozen=True)
class TrackerConfig:
    """Parameters of the tracker with the contract's defaults."""

    config_id: str = "default"
    gate_distance_px: float = 20.0
    confirmation_observations: int = 3
    max_consecutive_misses: int = 2
    motion_aware: bool = True


@dataclass
class ActiveTrack:
    track_no: int
    misses: int = 0
    count: int = 0
    quality_sum: float = 0.0
    last: tuple | None = None  # (frame, x, y)
    before: tuple | None = None
    points: list = field(default_factory=list)

    def predict(self, frame: int, motion_aware: bool) -> tuple[float, float]:
        lf, lx, ly = self.last
        if not motion_aware or self.before is None:
            return lx, ly
        bf, bx, by = self.before
        gap = lf - bf
        if gap <= 0:
            return lx, ly
        ahead = frame - lf
        return lx + (lx - bx) / gap * ahead, ly + (ly - by) / gap * ahead

    def observe(self, frame, x, y, quality, point) -> None:
        self.before, self.last = self.last, (frame, x, y)
        self.count += 1
        self.misses = 0
        self.quality_sum += quality
        self.points.append(point)

    def status(self, confirm: int) -> str:
        return "confirmed" if self.count >= confirm else "tentative"

    def quality(self) -> float:
        return min(1.0, max(0.0, self.quality_sum / self.count)) if self.count else 0.5


class SequenceStepper:
    """Active tracks of one sequence under one configuration."""

    def __init__(self, config: TrackerConfig, next_no: int = 1):
        self.config = config
        self.active: list[ActiveTrack] = []
        self.next_no = next_no
        self.last_frame: int | None = None

    def step(self, frame, dets, trace: list | None = None) -> list[ActiveTrack]:
        """Process one frame; dets = [(detection_id, x, y, quality, payload)] in id order.

        Returns the tracks that ended in this frame.
        """
        cfg = self.config
        self.last_frame = frame
        taken_tracks: dict[int, int] = {}
        if self.active and dets:
            spots = [t.predict(frame, cfg.motion_aware) for t in self.active]
            edges = gate_edges(spots, dets, cfg.gate_distance_px)
            taken_tracks = dict(solve(edges))
        if trace is not None:
            self._record(frame, dets, taken_tracks, trace)
        used = set(taken_tracks.values())
        ended, still = [], []
        for i, track in enumerate(self.active):
            j = taken_tracks.get(i)
            if j is None:
                track.misses += 1
                (ended if track.misses > cfg.max_consecutive_misses else still).append(track)
            else:
                _, x, y, q, payload = dets[j]
                track.observe(frame, x, y, q, payload)
                still.append(track)
        for j, (_, x, y, q, payload) in enumerate(dets):
            if j not in used:
                born = ActiveTrack(self.next_no)
                self.next_no += 1
                born.observe(frame, x, y, q, payload)
                still.append(born)
        self.active = still
        return ended

    def _record(self, frame, dets, taken, trace) -> None:
        """Rows of the association trace, in the column order of its schema."""
        spots = [t.predict(frame, self.config.motion_aware) for t in self.active]
        edges = gate_edges(spots, dets, self.config.gate_distance_px) if spots and dets else []
        trace.append((frame, "frame", None, None, None, None, None, None, None, len(spots) * len(dets) - len(edges)))
        for i, j, d in edges:
            x, y = spots[i]
            trace.append((frame, "pair", self.active[i].track_no, dets[j][0], x, y, d, True, taken.get(i) == j, None))
        for i, (x, y) in enumerate(spots):
            if i not in taken:
                trace.append((frame, "missed", self.active[i].track_no, None, x, y, None, None, None, None))
        used = set(taken.values())
        fresh = [d for j, d in enumerate(dets) if j not in used]
        for no, det in enumerate(fresh, self.next_no):
            trace.append((frame, "birth", no, det[0], None, None, None, None, None, None))


def gate_edges(spots, dets, gate: float) -> list[tuple[int, int, float]]:
    """(track, detection, distance) inside the gate.

    A crowded frame is swept along x first. Both ways square, add and take the correctly
    rounded root of the same differences, so a distance has the same bits in either.
    """
    if len(spots) * len(dets) <= 400:
        out = []
        for i, (px, py) in enumerate(spots):
            for j, det in enumerate(dets):
                dx, dy = px - det[1], py - det[2]
                d = math.sqrt(dx * dx + dy * dy)
                if d <= gate:
                    out.append((i, j, d))
        return out
    xs = np.array([d[1] for d in dets], dtype=float)
    ys = np.array([d[2] for d in dets], dtype=float)
    order = np.argsort(xs, kind="stable")
    xs, ys = xs[order], ys[order]
    out = []
    for i, (px, py) in enumerate(spots):
        reach = gate * (1 + 1e-9)
        lo, hi = np.searchsorted(xs, px - reach, "left"), np.searchsorted(xs, px + reach, "right")
        dx, dy = px - xs[lo:hi], py - ys[lo:hi]
        d = np.sqrt(dx * dx + dy * dy)
        for k in np.flatnonzero(d <= gate):
            out.append((i, int(order[lo + k]), float(d[k])))
    return out

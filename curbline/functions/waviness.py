"""Bending detector: upright edges that bend alike across a picture are a stitching or shutter fault.

Edges are followed row by row.  A trace is bent if it leaves its quadratic trend by enough, for its noise too; long
bent traces that leave their straight trends alike, in the same or in opposite directions, support each other.  The
score weighs the bend, the number of places across the picture, the agreement, and how much of all edge length agrees.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

import numpy as np

from .pixels import gaussian, grey, is_equirectangular, shrink, sobel, suppressed

MOST_TRACES = 180
#: Shares of the width or height, and counts, that the rules go by.
JUMP, FILLED = 5.0, 0.9
TILTED_BEND, NOISE_FLOOR, NOISE_TIMES = 0.003, 0.35, 5.0
SAME_OVERLAP, SAME_PIXELS, SAME_SHARE = 0.65, 4.0, 0.004
LONG, OVERLAP, OVERLAP_OF_SHORTER, SEPARATION = 0.15, 0.10, 0.60, 0.025
LEAST_PIXELS, LEAST_SHARE = 2.0, 0.001


@dataclass(frozen=True)
class Settings:
    """Working size, span and bend of traces, agreement of pairs, and the score from which a picture is called wavy."""

    long_side: int = 1280
    min_span: float = 0.09
    bend_percent: float = 0.20
    correlation: float = 0.78
    decision: float = 45.0

    def __post_init__(self):
        bounds = {"long_side": (640, 1920), "min_span": (0.05, 0.3), "bend_percent": (0.05, 2.0), "correlation": (0.5, 0.99), "decision": (0.0, 100.0)}
        for name in (f.name for f in fields(self)):
            value, (lo, hi) = getattr(self, name), bounds[name]
            if not (math.isfinite(value) and lo <= value <= hi):
                raise ValueError(f"{name} lies between {lo} and {hi}")


def detrend(values: np.ndarray, degree: int = 1) -> np.ndarray:
    """Values less their least-squares polynomial over [-1, 1]."""
    basis = np.vander(np.linspace(-1, 1, len(values)), degree + 1)
    return values - basis @ np.linalg.lstsq(basis, values, rcond=None)[0]


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    return gaussian(np.asarray(values, np.float32)[:, None], sigma)[:, 0] if len(values) > 1 else np.asarray(values, float)


def amplitude(values: np.ndarray) -> float:
    low, high = np.percentile(values, (5, 95))
    return float(high - low)


@dataclass
class Trace:
    """One upright edge: a smoothed column for each row from ``top`` on."""

    top: int
    xs: np.ndarray
    tilt_bend: float  # amplitude around its straight trend
    bend: float  # amplitude around its quadratic trend
    bent: bool

    @property
    def span(self) -> int:
        return len(self.xs) - 1

    @property
    def centre(self) -> float:
        return float(self.xs.mean())

    def common(self, other: Trace) -> tuple[int, int]:
        """First and last row of both; the last is before the first if there is none."""
        return max(self.top, other.top), min(self.top + self.span, other.top + other.span)

    def at(self, first: int, last: int) -> np.ndarray:
        return self.xs[first - self.top : last - self.top + 1]


def trace_of(ys: np.ndarray, xs: np.ndarray, width: int, s: Settings) -> Trace | None:
    """The trace of a chain of edge pixels, one for each row; None where rows are missing or it jumps."""
    rows = np.arange(ys[0], ys[-1] + 1)
    line = np.interp(rows, ys, xs)
    if len(ys) < FILLED * len(rows) or np.abs(np.diff(line)).max() > JUMP:
        return None
    even = smooth(line, max(2.0, 0.015 * len(line)))
    tilt_bend, bend, noise = amplitude(detrend(even, 1)), amplitude(detrend(even, 2)), float(np.median(np.abs(line - even)))
    bent = bend >= max(width * s.bend_percent / 100, NOISE_TIMES * max(noise, NOISE_FLOOR)) and tilt_bend >= TILTED_BEND * width
    return Trace(int(ys[0]), even, tilt_bend, bend, bent)


def edge_map(g: np.ndarray) -> np.ndarray:
    """Edges whose thresholds follow the picture's contrast."""
    even = np.clip(np.rint(gaussian(g, 0.9)), 0, 255).astype(np.uint8)
    strength = np.hypot(*sobel(even))
    marked = strength[strength > 6]
    high = float(np.clip(np.percentile(marked, 65), 40, 100)) if marked.size else 70.0
    return suppressed(even, 0.35 * high, high, euclidean=True)


def chains(edges: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edge pixels followed downwards, to a touching pixel of the next row; missing rows end them."""
    open_: list[tuple[list[int], list[int]]] = []
    done: list[tuple[list[int], list[int]]] = []
    for y in range(edges.shape[0]):
        here = np.flatnonzero(edges[y])
        taken = np.zeros(here.size, bool)
        kept = []
        for ys, xs in sorted(open_, key=lambda c: -len(c[0])):
            at = int(np.searchsorted(here, xs[-1]))
            near = [k for k in (at - 1, at) if 0 <= k < here.size and not taken[k] and abs(here[k] - xs[-1]) <= 1]
            if near:
                best = min(near, key=lambda k: abs(here[k] - xs[-1]))
                taken[best] = True
                ys.append(y)
                xs.append(int(here[best]))
                kept.append((ys, xs))
            else:
                done.append((ys, xs))
        open_ = kept + [([y], [int(x)]) for x in here[~taken]]
    return [(np.array(ys), np.array(xs)) for ys, xs in done + open_]


def traces(g: np.ndarray, s: Settings) -> list[Trace]:
    """The longest traces; of two that run side by side within a few pixels, the longer one."""
    height, width = g.shape
    least = max(30, int(height * s.min_span))
    found = [trace_of(ys, xs, width, s) for ys, xs in chains(edge_map(g)) if ys[-1] - ys[0] >= least]
    out: list[Trace] = []
    for t in sorted((t for t in found if t is not None), key=lambda t: -t.span):
        for o in out:
            first, last = t.common(o)
            if last - first >= SAME_OVERLAP * min(t.span, o.span) and np.median(np.abs(t.at(first, last) - o.at(first, last))) < max(SAME_PIXELS, SAME_SHARE * width):
                break
        else:
            out.append(t)
            if len(out) == MOST_TRACES:
                break
    return out


def agreement(a: Trace, b: Trace, width: int, height: int) -> float | None:
    """Size of the correlation of two traces around their straight trends; None if they cannot be compared."""
    first, last = a.common(b)
    if last - first < max(OVERLAP * height, OVERLAP_OF_SHORTER * min(a.span, b.span)):
        return None
    p, q = a.at(first, last), b.at(first, last)
    if np.median(np.abs(p - q)) < SEPARATION * width:
        return None
    p, q = detrend(p), detrend(q)
    if min(amplitude(p), amplitude(q)) < max(LEAST_PIXELS, LEAST_SHARE * width):
        return None
    return abs(float(np.corrcoef(p, q)[0, 1]))


def shared_bending(found: list[Trace], width: int, height: int, s: Settings) -> tuple[set[int], list[float]]:
    """Traces that support each other, and how well each such pair agrees (3 dp)."""
    members: set[int] = set()
    pairs: list[float] = []
    bent = [i for i, t in enumerate(found) if t.bent and t.span >= LONG * height]
    for n, i in enumerate(bent):
        for j in bent[n + 1 :]:
            r = agreement(found[i], found[j], width, height)
            if r is not None and r >= s.correlation:
                members |= {i, j}
                pairs.append(round(r, 3))
    return members, pairs


def support_groups(centres: list[float], width: int) -> int:
    """Places across the picture: a new one begins a separation beyond the first centre of the last."""
    count, first = 0, -math.inf
    for c in sorted(centres):
        if c - first >= SEPARATION * width:
            count, first = count + 1, c
    return count


def analyse(img: np.ndarray, settings: Settings | None = None) -> dict:
    """``waviness_label``, ``waviness_score`` (0 to 100, one decimal), ``confidence`` and what they rest on, of a flat picture."""
    s = settings or Settings()
    g = grey(shrink(img, s.long_side))
    height, width = g.shape
    found = traces(g, s)
    members, pairs = shared_bending(found, width, height, s)
    support = support_groups([found[i].centre for i in members], width)
    shared = sum(found[i].span for i in members) / max(1, sum(t.span for t in found))
    long_ = sum(t.span >= LONG * height for t in found)
    score = bend = 0.0
    if support >= 2:
        bend = float(np.median([found[i].bend for i in members])) / width * 100
        score = 100 * min(1.0, bend / (2.2 * s.bend_percent)) * min(1.0, support / 3) * float(np.median(pairs)) * min(1.0, shared / 0.30)
        score = round(score if support >= 3 else min(score, 30.0), 1)
    confidence = "high" if len(found) >= 6 and support >= 3 and shared >= 0.25 else "medium" if len(found) >= 3 else "low"
    if len(found) < 3 or (long_ < 6 and support < 3):
        label, confidence = "insufficient_evidence", "low"
    elif score >= s.decision and support >= 3:
        label = "wavy"
    elif score >= 0.65 * s.decision:
        label = "review"
    else:
        label, confidence = "no_strong_evidence", "medium" if len(found) >= 6 else "low"
    return {
        "waviness_label": label, "waviness_score": score, "confidence": confidence, "traces": len(found), "bent": sum(t.bent for t in found), "supported": len(members),
        "support": support, "shared_percent": round(100 * shared, 1), "long_edges": long_, "median_bend_percent": round(bend, 3),
    }


def check(img: np.ndarray, settings: Settings | None = None) -> dict:
    """Flat pictures only; a 360° picture is not checked."""
    h, w = img.shape[:2]
    return {"waviness_label": None, "waviness_score": None, "traces": 0, "support": 0} if is_equirectangular(w, h) else analyse(img, settings)

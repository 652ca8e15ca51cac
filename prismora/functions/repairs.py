"""Repairs of one spectrum on wavelengths x. A repair gives the new values, or None where it does not apply.

Most replace a window by a line between shoulders or from one side, and fade it in on a ramp. Thresholds and windows
are parameters; operators/repairs.py has those of the sources.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from .series import fill_linear
from .whittaker import smooth

Span = tuple[float, float]
BOUNDS, CLIP = (-0.05, 1.05), (0.0, 1.0)


def inside(x: np.ndarray, span: Span) -> np.ndarray:
    return (x >= span[0]) & (x <= span[1])


def ramp(x: np.ndarray, start: float, end: float, half: float) -> np.ndarray:
    """Weights 0 to 1 over start -+ half, and back to 0 over end -+ half; in narrow windows the way down rules."""
    if half <= 0:
        return inside(x, (start, end)).astype(float)
    return np.clip(np.where(x > end - half, end + half - x, x - (start - half)) / (2 * half), 0.0, 1.0)


def step_up(x: np.ndarray, center: float, half: float) -> np.ndarray:
    """Weights 0 below center - half, 1 above center + half."""
    return np.clip((x - (center - half)) / (2 * half), 0.0, 1.0)


def usable(y: np.ndarray, bounds: Span = BOUNDS) -> np.ndarray:
    return np.isfinite(y) & (y >= bounds[0]) & (y <= bounds[1])


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of every run of true values."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def largest(v: np.ndarray) -> float:
    """Largest finite value, NaN without one."""
    f = v[np.isfinite(v)]
    return float(f.max()) if len(f) else float("nan")


def jump(y: np.ndarray) -> float:
    """Largest step between neighbours that are both there."""
    return largest(np.abs(np.diff(y)))


def line_through(x: np.ndarray, y: np.ndarray) -> tuple[float, float] | None:
    """(slope, intercept) by least squares over finite values, two at least."""
    ok = np.isfinite(y)
    return tuple(np.polyfit(x[ok].astype(float), y[ok], 1)) if ok.sum() >= 2 else None


def faded(y: np.ndarray, at: np.ndarray, weight: np.ndarray, new: np.ndarray) -> np.ndarray:
    """y with (1 - weight) y + weight new at the places; missing values stay missing."""
    out = y.copy()
    out[at] = (1 - weight) * y[at] + weight * new
    return out


@dataclass(frozen=True)
class Bridge:
    """A window bridged between two shoulders."""

    name: str
    replace: Span
    left: Span
    right: Span
    half: float = 50.0  # of the ramps
    center: str = "mean"  # of a shoulder: mean or median
    least: int = 2  # values in each shoulder
    only_usable: bool = False  # shoulders from values inside BOUNDS only
    straight: bool = True  # beyond the shoulders' centers the line goes on, or is held
    falling: bool = False  # only where the left shoulder is the higher
    clip: Span | None = CLIP
    judged: Span | None = None  # window of the triggers, if not `replace`
    rise: float | None = None  # trigger: value over the line, at least
    off: float | None = None  # trigger: distance from the line, above
    steps: float | None = None  # trigger: step between neighbours, above
    every: bool = False  # all triggers must hold, or one of them
    range_counts: Span | None = None  # values outside (or missing) are a trigger
    whole: bool = False  # the window itself takes the line, not only the ramp's share
    always: bool = False


def bridged(y: np.ndarray, x: np.ndarray, r: Bridge) -> np.ndarray | None:
    pick = np.nanmedian if r.center == "median" else np.nanmean
    ends = []
    for span in (r.left, r.right):
        at = inside(x, span)
        ok = at & (usable(y) if r.only_usable else np.isfinite(y))
        if ok.sum() < r.least:
            return None
        ends.append((float(x[ok if r.only_usable else at].mean()), float(pick(y[ok]))))
    (x0, y0), (x1, y1) = ends
    if r.falling and not y0 > y1:
        return None

    def line(at: np.ndarray) -> np.ndarray:
        return y0 + (y1 - y0) * (at - x0) / (x1 - x0) if r.straight else np.interp(at, [x0, x1], [y0, y1])

    clip = (lambda v: np.clip(v, *r.clip)) if r.clip else (lambda v: v)
    at = inside(x, r.judged or r.replace)
    given, ideal = y[at], line(x[at].astype(float))
    if r.judged is None and r.straight:
        ideal = clip(ideal)
    held = []
    if r.rise is not None:
        top = largest(given - ideal)
        held.append(top > r.rise if r.every else top >= r.rise)
    if r.off is not None:
        held.append(largest(np.abs(given - ideal)) > r.off)
    if r.steps is not None:
        held.append(jump(given) > r.steps)
    if r.range_counts is not None:
        held.append(bool((~usable(given, r.range_counts)).any() if r.only_usable else (np.isfinite(given) & ~usable(given, r.range_counts)).any()))
    if not (r.always or (all(held) if r.every else any(held))):
        return None
    a, b = r.replace
    near = inside(x, (a - r.half, b + r.half))
    out = faded(y, near, ramp(x[near], a, b, r.half), clip(line(x[near].astype(float))))
    if r.whole:
        mid = inside(x, r.replace)
        out[mid] = clip(line(x[mid].astype(float))) if r.straight or r.clip else line(x[mid].astype(float))
    return out


def spikes(y: np.ndarray, x: np.ndarray, span: Span, pad: int, threshold: float, steps: float | None = None, most: int | None = None) -> np.ndarray | None:
    """Replace, one at a time, the value furthest from the line between its neighbours `pad` places away.

    It must be off by `threshold` or more; with `steps`, by more than the threshold, and with a larger step to a neighbour.
    """
    out, at = y.copy(), np.flatnonzero(inside(x, span))
    at = at[(at >= pad) & (at < len(y) - pad)]
    changed = False
    for _ in range(most if most is not None else 3 * int(inside(x, span).sum())):
        if not len(at):
            break
        share = (x[at] - x[at - pad]) / (x[at + pad] - x[at - pad])
        line = out[at - pad] + (out[at + pad] - out[at - pad]) * share
        off = np.abs(out[at] - line)
        if steps is None:
            ok = np.isfinite(off) & (off >= threshold) & (off > 0)
        else:
            before = np.where(at > 0, np.abs(out[at] - out[at - 1]), 0.0)
            after = np.abs(out[np.minimum(at + 1, len(out) - 1)] - out[at])
            ok = np.isfinite(off) & (off > threshold) & (np.fmax(np.nan_to_num(before), np.nan_to_num(after)) > steps)
        if not ok.any():
            break
        k = int(np.where(ok, off, -1).argmax())
        out[at[k]], changed = line[k], True
    return out if changed else None


def tail_line(y: np.ndarray, x: np.ndarray, fit: Span, tail: Span, half: float, drift: float) -> np.ndarray | None:
    """The line through `fit` goes on where the tail leaves it by `drift` or more; faded in around the tail's start."""
    line = line_through(x[inside(x, fit)], y[inside(x, fit)])
    at = inside(x, (tail[0] - half, tail[1]))
    if line is None or not np.isfinite(y[inside(x, tail)]).any():
        return None
    new = np.clip(line[0] * x[at] + line[1], *CLIP)
    own = inside(x[at], tail)
    if not largest(np.abs(y[at][own] - new[own])) >= drift:
        return None
    return faded(y, at, step_up(x[at], tail[0], half), new)


def tail_ramp(y: np.ndarray, x: np.ndarray, fit: Span, blend: Span, tail: Span, bounds: Span, steps: float, off: float) -> np.ndarray | None:
    """The line through `fit` replaces the tail, fading in over `blend`, where the tail leaves the bounds, jumps or drifts."""
    line = line_through(x[inside(x, fit)], y[inside(x, fit)])
    at, near = inside(x, tail), inside(x, blend)
    given = y[at]
    if line is None or not np.isfinite(given).any():
        return None
    new = np.clip(line[0] * x[at] + line[1], *bounds)
    low, high = np.nanmin(given), np.nanmax(given)
    if not (low < bounds[0] or high > bounds[1] or jump(y[inside(x, (tail[0] - 1, tail[1]))]) > steps or largest(np.abs(given - new)) > off):
        return None
    out = faded(y, near, np.linspace(0.0, 1.0, int(near.sum())), np.clip(line[0] * x[near] + line[1], *bounds))
    out[at] = new
    return out


def tail_drift(y: np.ndarray, x: np.ndarray, left: Span, end: float) -> float:
    """How far the last ten places leave the line through the left shoulder's usable values."""
    at = inside(x, left) & usable(y)
    line = line_through(x[at], y[at]) if at.sum() >= 4 else None
    last = inside(x, (end - 10, end)) & np.isfinite(y)
    return float("nan") if line is None or last.sum() < 3 else float(np.abs(y[last] - (line[0] * x[last] + line[1])).max())


def _tail_needs(y: np.ndarray, x: np.ndarray, left: Span, tail: Span, steps: float, drift: float) -> bool:
    at = inside(x, tail)
    return bool((~usable(y[at])).any() or jump(y[at]) > steps or tail_drift(y, x, left, tail[1]) > drift)


def tail_from_left(y: np.ndarray, x: np.ndarray, left: Span = (2300, 2370), tail: Span = (2380, 2500), half: float = 20.0, steps: float = 0.03, drift: float = 0.05) -> np.ndarray | None:
    """The line through the left shoulder's usable values, eight at least, replaces a tail that needs it."""
    ok = inside(x, left) & usable(y)
    line = line_through(x[ok], y[ok]) if ok.sum() >= 8 else None
    if line is None or not _tail_needs(y, x, left, tail, steps, drift):
        return None
    near, at = inside(x, (tail[0] - half, tail[1])), inside(x, tail)
    out = faded(y, near, ramp(x[near], *tail, half), np.clip(line[0] * x[near] + line[1], *CLIP))
    out[at] = np.clip(line[0] * x[at] + line[1], *CLIP)
    return out


def smoothed_part(y: np.ndarray, x: np.ndarray, span: Span, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """(smooth, weights) over the span, gaps filled first; NaN outside it, and all with under four values."""
    at = inside(x, span)
    part = fill_linear(y[at])
    z, w = np.full(len(y), np.nan), np.full(len(y), np.nan)
    if np.isfinite(part).sum() >= 4:
        a, b = smooth(part[None], strength)
        z[at], w[at] = a[0], b[0]
    return z, w


def _left_of(start: float, cut: float, low: float) -> Span:
    return max(low, start), max(start + 5, cut - 10)


def tail_smoothed(y: np.ndarray, x: np.ndarray, start: float, cut: float, strength: float, end: float = 2500, half: float = 20.0, steps: float = 0.03, drift: float = 0.05) -> np.ndarray | None:
    """A robust smooth from `start` on replaces the tail from `cut` on where that needs it."""
    if not _tail_needs(y, x, _left_of(start, cut, x[0]), (cut, end), steps, drift):
        return None
    z = np.clip(smoothed_part(y, x, (start, end), strength)[0], *CLIP)
    near, at = inside(x, (max(x[0], cut - half), end)), inside(x, (cut, end))
    if not np.isfinite(z[near]).any():
        return None
    out = faded(y, near, ramp(x[near], cut, end, half), fill_linear(z[near]))
    out[at] = z[at]
    return out


def tail_extrapolated(y: np.ndarray, x: np.ndarray, start: float, cut: float, strength: float, hold: bool, end: float = 2500, half: float = 20.0, steps: float = 0.03, drift: float = 0.05) -> np.ndarray | None:
    """A tail that needs it goes on from the robust smooth of start..cut: held at its end, or along its last 20 nm."""
    if not _tail_needs(y, x, _left_of(start, cut, x[0]), (cut, end), steps, drift):
        return None
    z = np.clip(smoothed_part(y, x, (start, cut), strength)[0], *CLIP)
    if not np.isfinite(z).any():
        return None
    at, near = inside(x, (cut, end)), inside(x, (max(x[0], cut - half), end))
    last = z[inside(x, (cut, cut))][0]
    fit = inside(x, (max(start, cut - 20), cut)) & np.isfinite(z)
    line = None if hold or fit.sum() < 4 else line_through(x[fit], z[fit])
    tail = np.full(int(at.sum()), last) if line is None else line[0] * x[at] + line[1]
    tail = np.clip(tail, *CLIP)
    new = y.copy()
    before = (x < cut) & np.isfinite(z)
    new[before] = z[before]
    new[at] = tail
    out = faded(y, near, ramp(x[near], cut, end, half), new[near])
    out[at] = tail
    return out


def segments(y: np.ndarray, x: np.ndarray, points: int = 16, half: int = 5, low: float = 0.0) -> np.ndarray | None:
    """Runs of values out of bounds, with their middle at `low` nm or above, become a line between the medians of the
    usable values among the `points` on both sides, or the line through those of one side."""
    out, changed = y.copy(), False
    for a, b in runs(np.isfinite(y) & ~usable(y)):
        if x[(a + b) // 2] < low:
            continue
        left, right = np.arange(max(0, a - points), a), np.arange(b + 1, min(len(y), b + 1 + points))
        left, right = left[usable(out[left])], right[usable(out[right])]
        at = np.arange(a, b + 1)
        both = len(left) and len(right)
        ends = ([float(x[left].mean()), float(x[right].mean())], [float(np.median(out[left])), float(np.median(out[right]))]) if both else None
        if len(left) >= 2 and len(right) >= 2:
            new = np.interp(x[at], *ends)
        elif len(left) >= 2 or len(right) >= 2:
            side = left if len(left) >= 2 else right
            line = line_through(x[side], out[side])
            new = line[0] * x[at] + line[1]
        else:
            continue
        new = np.clip(new, *CLIP)
        near = np.arange(max(0, a - half), min(len(y) - 1, b + half) + 1)
        fade = np.interp(x[near], *ends) if both else np.interp(x[near], [x[a], x[b]], [new[0], new[-1]])
        out = faded(out, near, ramp(x[near], x[a], x[b], half), np.clip(fade, *CLIP))
        out[at], changed = new, True
    return out if changed else None


def constrained_tail(y: np.ndarray, x: np.ndarray, early: Span = (2250, 2270), late: Span = (2275, 2295), tail: Span = (2300, 2500), half: float = 20.0, steepest: float = 5e-4, watched: Span = (2330, 2500), steps: float = 0.05, off: float = 0.08) -> np.ndarray | None:
    """A line from the late shoulder's median, its slope from both shoulders but no steeper than `steepest`."""
    whole = inside(x, (early[0], late[1])) & usable(y)
    a, b = inside(x, early) & usable(y), inside(x, late) & usable(y)
    if whole.sum() < 8 or a.sum() < 4 or b.sum() < 4:
        return None
    x0, y0, x1, y1 = x[a].mean(), np.median(y[a]), x[b].mean(), np.median(y[b])
    slope = float(np.clip((y1 - y0) / max(1.0, x1 - x0), -steepest, steepest))
    line = lambda at: y1 + slope * (x[at] - x1)
    at, near = inside(x, tail), inside(x, (tail[0] - half, min(x[-1], tail[1] + half)))
    if not ((~usable(y[at])).any() or jump(y[inside(x, watched)]) > steps or largest(np.abs(y[at] - line(at))) > off):
        return None
    out = faded(y, near, ramp(x[near], *tail, half), np.clip(line(near), *CLIP))
    out[at] = np.clip(line(at), *CLIP)
    return out


def robust_bands(y: np.ndarray, x: np.ndarray, strength: float = 2000.0, weight: float = 0.1, off: float = 0.01, half: float = 10.0) -> np.ndarray | None:
    """Runs of values that the robust smooth of the whole spectrum weighs under `weight`, or out of bounds, and off it
    by more than `off`, become the smooth."""
    z, w = smoothed_part(y, x, (x[0], x[-1]), strength)
    if not np.isfinite(z).any():
        return None
    flagged = np.isfinite(y) & ((w < weight) | ~usable(y)) & (np.abs(y - z) > off)
    if not flagged.any():
        return None
    out = y.copy()
    for a, b in runs(flagged):
        near = inside(x, (x[a] - half, x[b] + half))
        out = faded(out, near, ramp(x[near], x[a], x[b], half), z[near])
        out[a : b + 1] = np.clip(z[a : b + 1], *CLIP)
    return np.clip(out, *CLIP)


def smooth_above(y: np.ndarray, x: np.ndarray, center: float = 800.0, half: float = 50.0, strength: float = 50_000.0) -> np.ndarray | None:
    """A strong smooth of the whole spectrum takes over around `center`; missing values become the smooth."""
    z = smoothed_part(y, x, (x[0], x[-1]), strength)[0]
    if not np.isfinite(z).any():
        return None
    z = np.clip(fill_linear(z), *CLIP)
    w = step_up(x, center, half)
    return np.where(np.isfinite(y), (1 - w) * y + w * z, z)


def visible_splice(y: np.ndarray, x: np.ndarray, skip_edge: bool, span: Span = (400, 900), steps: float = 0.05, half: float = 8.0, gap: float = 4.0, width: float = 12.0, edge: Span = (680, 720)) -> np.ndarray | None:
    """The largest step in the visible is bridged if it is over `steps`; skip_edge: not where vegetation rises anyway."""
    at = np.flatnonzero(inside(x, span))
    d = np.abs(np.diff(y[at]))
    if not np.isfinite(d).any():
        return None
    k = int(np.nanargmax(d))
    nm = float(x[at[k]])
    if d[k] <= steps or (skip_edge and edge[0] <= nm <= edge[1]):
        return None
    a, b = max(span[0], nm - half), min(span[1], nm + 1 + half)
    left = max(span[0], a - gap - width), max(span[0], a - gap)
    right = min(span[1], b + gap), min(span[1], min(span[1], b + gap) + width)
    return bridged(y, x, Bridge("splice", (a, b), left, right, half, "median", 4, True, False, always=True, whole=True))


def stretched(y: np.ndarray, x: np.ndarray, template: np.ndarray, left: float, right: float, replace: Span) -> np.ndarray | None:
    """A part of the template, stretched so that it meets the spectrum at both anchors, replaces the window."""
    a, b = int(np.flatnonzero(x == left)[0]), int(np.flatnonzero(x == right)[0])
    span = template[b] - template[a]
    if not np.isfinite(span) or abs(span) < 1e-12 or not (np.isfinite(y[a]) and np.isfinite(y[b])):
        return None
    out, at = y.copy(), inside(x, replace)
    out[at] = y[a] + (y[b] - y[a]) * (template[at] - template[a]) / span
    return out


def edge_bridge(y: np.ndarray, x: np.ndarray, start: float, end: float, anchor: float) -> np.ndarray | None:
    """The line from the value at `start` to that at `anchor` over start..end."""
    a, b = int(np.flatnonzero(x == start)[0]), int(np.flatnonzero(x == anchor)[0])
    if not (np.isfinite(y[a]) and np.isfinite(y[b])):
        return None
    out, at = y.copy(), inside(x, (start, end))
    out[at] = y[a] + (y[b] - y[a]) * (x[at] - start) / (anchor - start)
    return out


def backfilled(y: np.ndarray, x: np.ndarray, span: Span = (400, 550), points: int = 10) -> np.ndarray | None:
    """A leading gap of the span is filled by the line through its first `points` values, or by its only one."""
    at = np.flatnonzero(inside(x, span))
    there = at[np.isfinite(y[at])]
    if not len(there) or there[0] == at[0]:
        return None
    use, gap = there[:points], np.arange(at[0], there[0])
    line = line_through(x[use], y[use]) if len(use) >= 2 else (0.0, y[use[0]])
    out = y.copy()
    out[gap] = np.clip(line[0] * x[gap] + line[1], *CLIP)
    return out


# smoothing that must not make jumps, and the choice among variants


def kept_jump(y: np.ndarray) -> float:
    """Largest step between neighbouring values that are there, gaps skipped; 0 without two."""
    f = y[np.isfinite(y)]
    return float(np.abs(np.diff(f)).max()) if len(f) >= 2 else 0.0


def boundary_jump(y: np.ndarray, x: np.ndarray, span: Span) -> float:
    """Larger of the steps into and out of the span."""
    at = np.flatnonzero(inside(x, span))
    if not len(at):
        return 0.0
    steps = [abs(y[i + 1] - y[i]) for i in (at[0] - 1, at[-1]) if 0 <= i and i + 1 < len(y)]
    return max([float(s) for s in steps if np.isfinite(s)], default=0.0)


def curvature(y: np.ndarray) -> float:
    """Mean absolute second difference of the values that are there; 0 with under three."""
    f = y[np.isfinite(y)]
    return float(np.abs(np.diff(f, 2)).mean()) if len(f) >= 3 else 0.0


@dataclass(frozen=True)
class SmoothWindow:
    name: str
    replace: Span
    fit: Span
    strength: float

    def near(self, x: np.ndarray, half: float) -> np.ndarray:
        return inside(x, (max(self.fit[0], self.replace[0] - half), min(self.fit[1], self.replace[1] + half)))


def guarded(y: np.ndarray, x: np.ndarray, r: SmoothWindow, half: float = 50.0, slack: float = 5e-4) -> np.ndarray | None:
    """A robust smooth faded into the window, refused if a step inside or at its boundary grows by more than `slack`."""
    z = np.full(len(y), np.nan)
    at = inside(x, r.fit)
    z[at] = smooth(y[at][None], r.strength)[0][0]
    near = r.near(x, half)
    ok = np.isfinite(z[near]) & np.isfinite(y[near])
    if not ok.any():
        return None
    old = y[near]
    new = np.where(ok, (1 - ramp(x[near], *r.replace, half)) * old + ramp(x[near], *r.replace, half) * z[near], old)
    if kept_jump(new) > kept_jump(old) + slack or boundary_jump(new, x[near], r.replace) > boundary_jump(old, x[near], r.replace) + slack:
        return None
    out = y.copy()
    out[near] = new
    return out


def window_score(y: np.ndarray, x: np.ndarray, r: SmoothWindow, half: float = 50.0) -> tuple[float, float, float]:
    """(boundary step, largest step, curvature) of a window, the smaller the better, compared in this order."""
    near = r.near(x, half)
    return boundary_jump(y[near], x[near], r.replace), kept_jump(y[near]), curvature(y[near])


def best_of(variants: Sequence[np.ndarray], x: np.ndarray, r: SmoothWindow, half: float = 50.0) -> int:
    """Number of the variant with the least score; the first of equal ones."""
    scores = [window_score(v, x, r, half) for v in variants]
    return scores.index(min(scores))


# outliers by windows


@dataclass(frozen=True)
class OutlierWindow:
    start: int
    end: int
    strength: float
    off: float


def flagged(values: np.ndarray, x: np.ndarray, windows: Sequence[OutlierWindow], weight: float = 0.1, filled: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(mask, smooth) for the rows of a matrix: values of low weight and off the smooth of their window; later windows
    write the smooth of places they share. filled: gaps are filled before smoothing."""
    mask, z = np.zeros(values.shape, bool), np.full(values.shape, np.nan)
    base = np.array([fill_linear(row) for row in values]).reshape(values.shape) if filled else values
    for r in windows:
        at = np.flatnonzero(inside(x, (r.start, r.end)))
        if len(at) < 3:
            continue
        part = base[:, at]
        s, w = smooth(part, r.strength)
        z[:, at] = s
        mask[:, at] |= np.isfinite(values[:, at]) & (w < weight) & (np.abs(part - s) > r.off)
    return mask, z


def replace_flagged(values: np.ndarray, x: np.ndarray, windows: Sequence[OutlierWindow], weight: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(values, count replaced in each window): window after window, flagged values become the smooth."""
    out, counts = values.copy(), np.zeros((len(values), len(windows)), int)
    for k, r in enumerate(windows):
        mask, z = flagged(out, x, [r], weight)
        out = np.where(mask, z, out)
        counts[:, k] = mask.sum(axis=1)
    return out, counts


def blend_visible(values: np.ndarray, x: np.ndarray, mask: np.ndarray, span: Span = (400, 700), strength: float = 50.0, half: float = 50.0) -> tuple[np.ndarray, np.ndarray]:
    """(values, count changed): around flagged runs of the span the smooth of the span fades in."""
    at = np.flatnonzero(inside(x, span))
    out, changed = values.copy(), np.zeros(len(values), int)
    rows = np.flatnonzero(mask[:, at].any(axis=1))
    if not len(rows):
        return out, changed
    z, _ = smooth(values[np.ix_(rows, at)], strength)
    for k, row in enumerate(rows):
        w = np.max([ramp(x[at], x[at[a]], x[at[b]], half) for a, b in runs(mask[row, at])], axis=0)
        ok = np.isfinite(values[row, at]) & np.isfinite(z[k]) & (w > 0)
        out[row, at[ok]] = (1 - w[ok]) * values[row, at[ok]] + w[ok] * z[k][ok]
        changed[row] = ok.sum()
    return out, changed

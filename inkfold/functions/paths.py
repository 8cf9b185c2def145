"""SVG path geometry in NumPy: a path is an array of segments in absolute coordinates.

Points are complex numbers. A segment is a Bezier curve of 2 to 4 control points or an elliptical arc; lines,
quadratics and cubics share all code, arcs have their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np

# Numbers that each command takes at a time.
TAKES = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
LETTERS = "".join(k + k.lower() for k in TAKES)
_COMMAND = re.compile(rf"\s*([{LETTERS}])((?:[\s,]*{NUMBER})*)[\s,]*")
_NUMBERS = re.compile(NUMBER)
# In an arc the two flags may stand without any blank before what follows.
_ARC = re.compile(rf"[\s,]*({NUMBER})[\s,]*({NUMBER})[\s,]*({NUMBER})[\s,]*([01])[\s,]*([01])[\s,]*({NUMBER})[\s,]*({NUMBER})")


class Bezier(NamedTuple):
    points: tuple[complex, ...]

    @property
    def end(self) -> complex:
        return self.points[-1]

    def at(self, t: np.ndarray) -> np.ndarray:
        p, t = self.points, np.asarray(t, float)
        level = [np.full(t.shape, z) for z in p]
        while len(level) > 1:
            level = [a * (1 - t) + b * t for a, b in zip(level, level[1:], strict=False)]
        return level[0]

    def speed(self, t: np.ndarray) -> np.ndarray:
        d = len(self.points) - 1
        return Bezier(tuple(d * (b - a) for a, b in zip(self.points, self.points[1:], strict=False))).at(t)

    def extent(self) -> list[complex]:
        """Points among which are those of least and greatest x and y: the ends and where a coordinate turns."""
        p = self.points
        out = [p[0], p[-1]]
        if len(p) == 2:
            return out
        for v in ([z.real for z in p], [z.imag for z in p]):
            low, high = (v[0], v[-1]) if v[0] <= v[-1] else (v[-1], v[0])
            if low <= min(v[1:-1]) and max(v[1:-1]) <= high:  # between the ends all along
                continue
            d = [y - x for x, y in zip(v, v[1:], strict=False)]
            if len(d) == 2:
                bend = d[0] - d[1]
                roots = [d[0] / bend] if bend else []
            else:
                a, b, c = d[0] - 2 * d[1] + d[2], 2 * (d[1] - d[0]), d[0]
                if abs(a) < 1e-12:
                    roots = [-c / b] if b else []
                else:
                    under = b * b - 4 * a * c
                    roots = [(-b + s * under**0.5) / (2 * a) for s in (1, -1)] if under >= 0 else []
            out += [self.point(t) for t in roots if 0 < t < 1]
        return out

    def point(self, t: float) -> complex:
        level = list(self.points)
        while len(level) > 1:
            level = [x + (y - x) * t for x, y in zip(level, level[1:], strict=False)]
        return level[0]

    def mapped(self, f) -> Bezier:
        return Bezier(tuple(f(z) for z in self.points))


class Arc(NamedTuple):
    start: complex
    radius: complex
    rotation: float
    large: bool
    sweep: bool
    end: complex

    def _centre(self) -> tuple[complex, float, float, complex, complex]:
        """Centre, first angle, sweep, radii and turn, by the endpoint conversion of the SVG standard."""
        turn = complex(np.cos(np.radians(self.rotation)), np.sin(np.radians(self.rotation)))
        z = (self.start - self.end) / 2 / turn
        rx, ry = abs(self.radius.real), abs(self.radius.imag)
        grow = (z.real / rx) ** 2 + (z.imag / ry) ** 2
        if grow > 1:
            rx, ry = rx * grow**0.5, ry * grow**0.5
        rest = max(0.0, (rx * ry) ** 2 / ((rx * z.imag) ** 2 + (ry * z.real) ** 2) - 1) ** 0.5
        c = rest * (1 if self.large != self.sweep else -1) * complex(rx * z.imag / ry, -ry * z.real / rx)
        unit = lambda w: complex(w.real / rx, w.imag / ry)
        a, b = np.angle(unit(z - c)), np.angle(unit(-z - c))
        span = b - a
        if self.sweep and span < 0:
            span += 2 * np.pi
        elif not self.sweep and span > 0:
            span -= 2 * np.pi
        return c * turn + (self.start + self.end) / 2, float(a), float(span), complex(rx, ry), turn

    def at(self, t: np.ndarray) -> np.ndarray:
        centre, a, span, r, turn = self._centre()
        angle = a + span * np.asarray(t, float)
        return centre + turn * (r.real * np.cos(angle) + 1j * r.imag * np.sin(angle))

    def speed(self, t: np.ndarray) -> np.ndarray:
        _, a, span, r, turn = self._centre()
        angle = a + span * np.asarray(t, float)
        return span * turn * (-r.real * np.sin(angle) + 1j * r.imag * np.cos(angle))

    def extent(self) -> list[complex]:
        _, a, span, r, turn = self._centre()
        base = [np.arctan2(-r.imag * turn.imag, r.real * turn.real), np.arctan2(r.imag * turn.real, r.real * turn.imag)]
        t = np.array([(x + k * np.pi - a) / span for x in base for k in range(-4, 5)]) if span else np.zeros(0)
        return [self.start, self.end, *self.at(t[(t > 0) & (t < 1)])]

    def mapped(self, f) -> Arc:
        origin = f(0j)
        x, y = f(1 + 0j) - origin, f(1j) - origin
        if abs(x.imag) > 1e-12 or abs(y.real) > 1e-12:
            raise ValueError("arcs can be moved and scaled along the axes only")
        flip = x.real * y.imag < 0
        return Arc(f(self.start), complex(self.radius.real * abs(x.real), self.radius.imag * abs(y.imag)), -self.rotation if flip else self.rotation, self.large, self.sweep != flip, f(self.end))


Segment = Bezier | Arc


class Step(NamedTuple):
    """A command's letter in upper case with the segment it draws; a move draws none."""

    letter: str
    segment: Segment | None
    end: complex


@lru_cache(maxsize=4096)
def parse(data: str, strict: bool = False) -> tuple[Step, ...]:
    """The steps of path data. What can't be read ends the path, or raises if ``strict``. Drawings repeat their letters, so recent paths are kept."""
    steps: list[Step] = []
    here = first = 0j
    tail: complex | None = None  # last control point, for smooth curves
    before, at = "", 0
    while at < len(data):
        found = _COMMAND.match(data, at)
        arc = None
        if found and found[1] in "Aa":
            at, groups = found.start(2), []
            while arc := _ARC.match(data, at):
                groups.append([float(x) for x in arc.groups()])
                at = arc.end()
            while at < len(data) and data[at] in " \t\r\n,":
                at += 1
        elif found:
            numbers = [float(x) for x in _NUMBERS.findall(found[2])]
            take = TAKES[found[1].upper()]
            if take and (not numbers or len(numbers) % take):
                if strict:
                    raise ValueError(f"{found[1]} takes {take} numbers, got {len(numbers)}")
                numbers = numbers[: len(numbers) // take * take]
            groups = [numbers[k : k + take] for k in range(0, len(numbers), take)] if take else [[]]
            at = found.end()
        if not found or not steps and found[1] not in "Mm":
            if strict and data[at:].strip():
                raise ValueError(f"no path command at {at}")
            break
        letter, base = found[1].upper(), found[1].islower()
        for k, v in enumerate(groups):
            kind = "L" if letter == "M" and k else letter
            off = here if base else 0j
            z = [complex(v[j], v[j + 1]) + off for j in range(0, len(v) - 1, 2)] if kind in "MLCSQT" else []
            mirror = 2 * here - tail if tail is not None else here
            control = None
            if kind == "M":
                segment, end, first = None, z[0], z[0]
            elif kind == "L":
                segment, end = Bezier((here, z[0])), z[0]
            elif kind == "H":
                end = complex(v[0] + off.real, here.imag)
                segment = Bezier((here, end))
            elif kind == "V":
                end = complex(here.real, v[0] + off.imag)
                segment = Bezier((here, end))
            elif kind == "C":
                segment, end, control = Bezier((here, *z)), z[2], z[1]
            elif kind == "S":
                segment, end, control = Bezier((here, mirror if before in "CS" and before else here, *z)), z[1], z[0]
            elif kind == "Q":
                segment, end, control = Bezier((here, *z)), z[1], z[0]
            elif kind == "T":
                control = mirror if before in "QT" and before else here
                segment, end = Bezier((here, control, z[0])), z[0]
            elif kind == "A":
                end = complex(v[5], v[6]) + off
                flat = not v[0] or not v[1]
                segment = Bezier((here, end)) if flat or here == end else Arc(here, complex(v[0], v[1]), v[2], bool(v[3]), bool(v[4]), end)
            else:
                segment, end = Bezier((here, first)), first
            steps.append(Step(kind, segment, end))
            here, tail, before = end, control, kind
    return tuple(steps)


def written(steps: Sequence[Step], relative: bool = True, digits: int = 10) -> str:
    """Path data of the steps, each with its full command."""
    out, here, first = [], 0j, 0j

    def number(x: float) -> str:
        text = f"{round(x, digits):.{digits}f}".rstrip("0").rstrip(".")
        return "0" if text in ("-0", "") else text

    for s in steps:
        off = here if relative else 0j
        pair = lambda z: f"{number((z - off).real)},{number((z - off).imag)}"  # noqa: B023, E731
        if s.letter == "M":
            text, first = "M" + pair(s.end), s.end
        elif s.letter == "Z":
            text = "Z"
        elif isinstance(s.segment, Arc):
            a = s.segment
            text = f"A{number(a.radius.real)},{number(a.radius.imag)} {number(a.rotation)} {int(a.large)} {int(a.sweep)} {pair(a.end)}"
        else:
            text = " LQC"[len(s.segment.points) - 1] + " ".join(pair(z) for z in s.segment.points[1:])
        out.append(text.lower() if relative and out else text)
        here = first if s.letter == "Z" else s.end
    return "".join(out)


def box(steps: Sequence[Step]) -> tuple[float, float, float, float] | None:
    """``(xmin, ymin, width, height)`` of what is drawn; None for nothing."""
    z = [p for s in steps if s.segment is not None for p in s.segment.extent()]
    if not z:
        return None
    xs, ys = [p.real for p in z], [p.imag for p in z]
    x, y = min(xs), min(ys)
    return float(x), float(y), float(max(xs) - x), float(max(ys) - y)


@lru_cache(maxsize=1 << 16)
def extent_of(data: str) -> tuple[float, float, float, float] | None:
    """``box`` of path data. Drawings repeat their letters, so the boxes of recent paths are kept."""
    return box(parse(data))


def joined(boxes: Iterable[tuple[float, float, float, float] | None]) -> tuple[float, float, float, float] | None:
    """The box around boxes."""
    some = [b for b in boxes if b]
    if not some:
        return None
    x, y = min(b[0] for b in some), min(b[1] for b in some)
    return x, y, max(b[0] + b[2] for b in some) - x, max(b[1] + b[3] for b in some) - y


@cache
def _gauss(n: int = 24) -> tuple[np.ndarray, np.ndarray]:
    x, w = np.polynomial.legendre.leggauss(n)
    return (x + 1) / 2, w / 2


def length(segment: Segment, upto: float = 1.0, parts: int = 4) -> float:
    """Arc length from 0 to ``upto`` by Gauss-Legendre quadrature over equal parts."""
    if isinstance(segment, Bezier) and len(segment.points) == 2:
        return abs(segment.points[1] - segment.points[0]) * upto
    x, w = _gauss()
    edges = np.linspace(0, upto, parts + 1)
    t = (edges[:-1, None] + x * upto / parts).ravel()
    return float((np.abs(segment.speed(t)) * np.tile(w, parts)).sum() * upto / parts)


def sampled(steps: Sequence[Step], n: int) -> np.ndarray:
    """``n`` points at equal arc length along all that is drawn, first and last included; ``(n, 2)``.

    A path without length gives its only point ``n`` times; one that draws nothing an empty array.
    """
    segments = [s.segment for s in steps if s.segment is not None]
    if not segments:
        return np.zeros((0, 2))
    if n < 2:
        raise ValueError("at least two points are sampled")
    lengths = np.array([length(s) for s in segments])
    total = lengths.sum()
    if not total:
        z = np.full(n, segments[0].at(np.zeros(1))[0])
        return np.stack((z.real, z.imag), 1)
    ends = np.cumsum(lengths)
    wanted = np.linspace(0, total, n)
    of = np.minimum(np.searchsorted(ends, wanted, side="left"), len(segments) - 1)
    z = np.empty(n, complex)
    grid = np.linspace(0, 1, 65)
    for k in np.unique(of):
        mask = of == k
        speed = np.abs(segments[k].speed((grid[:-1] + grid[1:]) / 2))
        run = np.concatenate(([0], np.cumsum(speed)))
        run = run / run[-1] * lengths[k] if run[-1] else grid * lengths[k]
        z[mask] = segments[k].at(np.interp(wanted[mask] - (ends[k] - lengths[k]), run, grid))
    return np.stack((z.real, z.imag), 1)


def moved(steps: Sequence[Step], matrix: np.ndarray) -> list[Step]:
    """The steps under an affine map (3 x 3)."""
    f = lambda z: complex(matrix[0, 0] * z.real + matrix[0, 1] * z.imag + matrix[0, 2], matrix[1, 0] * z.real + matrix[1, 1] * z.imag + matrix[1, 2])
    return [Step(s.letter, s.segment.mapped(f) if s.segment else None, f(s.end)) for s in steps]


def transform_matrix(text: str) -> np.ndarray:
    """The matrix of a transform attribute; functions apply from the right."""
    out = np.eye(3)
    for name, inside in re.findall(r"(\w+)\s*\(([^()]*)\)", text):
        v = [float(x) for x in _NUMBERS.findall(inside)]
        m = np.eye(3)
        if name == "translate":
            m[0, 2], m[1, 2] = v[0], v[1] if len(v) > 1 else 0
        elif name == "scale":
            m[0, 0], m[1, 1] = v[0], v[1] if len(v) > 1 else v[0]
        elif name == "rotate":
            a = np.radians(v[0])
            m[:2, :2] = [[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]
            if len(v) == 3:
                there, back = np.eye(3), np.eye(3)
                there[:2, 2], back[:2, 2] = v[1:], [-v[1], -v[2]]
                m = there @ m @ back
        elif name in ("skewX", "skewY"):
            m[(0, 1) if name == "skewX" else (1, 0)] = np.tan(np.radians(v[0]))
        elif name == "matrix":
            m[:2] = np.array(v).reshape(3, 2).T
        else:
            raise ValueError(f"unknown transform {name}")
        out = out @ m
    return out


def same(a: str, b: str, tolerance: float = 0.0) -> bool:
    """Whether two paths draw the same segments within ``tolerance``."""
    x, y = parse(a), parse(b)
    if len(x) != len(y):
        return False
    for s, t in zip(x, y, strict=True):
        if type(s.segment) is not type(t.segment) or abs(s.end - t.end) > tolerance:
            return False
        if isinstance(s.segment, Bezier) and (len(s.segment.points) != len(t.segment.points) or any(abs(p - q) > tolerance for p, q in zip(s.segment.points, t.segment.points, strict=True))):
            return False
        if isinstance(s.segment, Arc) and (abs(s.segment.radius - t.segment.radius) > tolerance or (s.segment.rotation, s.segment.large, s.segment.sweep) != (t.segment.rotation, t.segment.large, t.segment.sweep)):
            return False
    return True

"""Outlines of a pixel mask as rings of corners, and their text form."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np

Ring = list[tuple[float, float]]
#: Corners times points that one test holds.
_AT_ONCE = 1 << 20


def outlines(mask: np.ndarray) -> list[Ring]:
    """Closed rings (x, y) around 4-connected pixels: outer ones have positive area, holes negative.

    Each pixel side between inside and outside is an edge with the inside on its right as seen
    in row order; edges chain to rings, turning so that pixels that meet at a corner only stay
    apart. Corners on straight sides are left out.
    """
    inside = np.pad(mask.astype(bool), 1)
    starts: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for y, x in zip(*np.nonzero(inside), strict=True):
        r, c = int(y) - 1, int(x) - 1
        if not inside[y - 1, x]:
            starts[(c, r)].append((c + 1, r))
        if not inside[y, x + 1]:
            starts[(c + 1, r)].append((c + 1, r + 1))
        if not inside[y + 1, x]:
            starts[(c + 1, r + 1)].append((c, r + 1))
        if not inside[y, x - 1]:
            starts[(c, r + 1)].append((c, r))
    rings = []
    for begin in sorted(starts):
        while starts[begin]:
            ring, at, came = [begin], starts[begin].pop(), begin
            while at != begin:
                step = (at[0] - came[0], at[1] - came[1])
                choice = starts[at]
                right = (at[0] - step[1], at[1] + step[0])
                onward = right if right in choice else choice[0]
                choice.remove(onward)
                if onward != (at[0] + step[0], at[1] + step[1]):
                    ring.append(at)
                came, at = at, onward
            last = (ring[0][0] - came[0], ring[0][1] - came[1])
            first = (ring[1][0] - ring[0][0], ring[1][1] - ring[0][1]) if len(ring) > 1 else last
            if last[0] * first[1] - last[1] * first[0] == 0:
                ring = ring[1:]
            rings.append([(float(a), float(b)) for a, b in ring])
    return rings


def area(ring: Ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def holds(ring: Ring, point: tuple[float, float]) -> bool:
    x, y = point
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


def _touched(chain: np.ndarray, points: np.ndarray) -> bool:
    """Whether any of the points, but for the chain's ends, lies in or on the closed curve of a chain of corners."""
    low, high = chain.min(axis=0), chain.max(axis=0)
    points = points[((points >= low) & (points <= high)).all(axis=1)]
    points = points[(points != chain[0]).any(axis=1) & (points != chain[-1]).any(axis=1)]
    after = np.roll(chain, -1, axis=0)
    (ax, ay), (bx, by) = chain.T, after.T
    for some in np.array_split(points, 1 + len(points) * len(chain) // _AT_ONCE):
        x, y = some[:, :1], some[:, 1:]
        turn = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
        on = (turn == 0) & (x >= np.minimum(ax, bx)) & (x <= np.maximum(ax, bx)) & (y >= np.minimum(ay, by)) & (y <= np.maximum(ay, by))
        crossed = ((ay > y) != (by > y)) & ((turn < 0) == (by < ay))
        if (on.any(axis=1) | (crossed.sum(axis=1) % 2 == 1)).any():
            return True
    return False


def _distances(chain: np.ndarray) -> np.ndarray:
    """Of the corners inside a chain from the line between its ends (and not beyond them)."""
    a, step = chain[0], chain[-1] - chain[0]
    inside = chain[1:-1] - a
    length = float(step @ step)
    along = np.clip(inside @ step / length, 0, 1) if length else np.zeros(len(inside))
    return np.hypot(*(inside - along[:, None] * step).T)


def simplified(rings: list[Ring], tolerance: float, place=lambda x, y: (x, y)) -> list[Ring]:
    """Rings with fewer corners, each left out within the tolerance, that touch and cross as before.

    rings are all outlines of one mask, in pixels, where whole numbers make every test exact. place is
    rings are all outlines of one mask, in pixels, where whole numbers make every test exact. place is
    affine, and distances are those of the places. A run of corners gives way to the line between its ends if all are
    within the tolerance of it, no corner of any other run, of this ring or another, lies in or on the area between the
    two, and no other line has the same ends; else it is parted at its farthest corner. So no line can reach
    another, a hole or an island stays on its side, at least three corners of a ring are left, and
    nothing needs repair. Corners where outlines touch stay, and so do two corners that are far apart of every ring.
    """
    if tolerance <= 0:
        return rings
    corners = np.array([c for r in rings for c in r], float).reshape(-1, 2)
    shared = {c for c, n in Counter(map(tuple, corners.tolist())).items() if n > 1}
    lines = {frozenset((a, b)) for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)}
    begin, out = 0, []
    for ring in rings:
        n, px = len(ring), np.array(ring, float)
        others = np.ones(len(corners), bool)
        places = np.array([place(*c) for c in ring], float)
        far = int(np.hypot(*(places - places[0]).T).argmax())
        keep = {0, far} | {k for k, c in enumerate(ring) if c in shared}
        fixed = sorted(keep)
        todo = [(i, k, _distances(places[np.arange(i, k + 1) % n])) for i, k in zip(fixed, [*fixed[1:], fixed[0] + n], strict=True) if k - i > 1]
        todo.sort(key=lambda run: -run[2].max())
        while todo:
            i, k, d = todo.pop()
            at, ends = np.arange(i, k + 1) % n, frozenset((ring[i], ring[k % n]))
            if d.max() <= tolerance and len(ends) == 2 and ends not in lines:
                others[begin + at] = False
                free = not _touched(px[at], corners[others])
                others[begin + at] = True
                if free:
                    lines.add(ends)
                    continue
            worst = i + 1 + (int(d.argmax()) if d.max() > 0 else (k - i) // 2 - 1)
            keep.add(worst % n)
            todo += [(a, b, _distances(places[np.arange(a, b + 1) % n])) for a, b in ((i, worst), (worst, k)) if b - a > 1]
        kept = [ring[j] for j in sorted(keep)]
        out.append(kept if area(kept) * area(ring) > 0 else ring)
        begin += n
    return out


def polygons(mask: np.ndarray, keep_holes: bool) -> list[list[Ring]]:
    """Outer rings, each followed by its holes. Without holes, what lies in a hole is covered."""
    rings = outlines(mask)
    outer = [[r] for r in rings if area(r) > 0]
    if keep_holes:
        for hole in (r for r in rings if area(r) < 0):
            inner = (hole[0][0], hole[0][1])
            probe = (inner[0] + 1e-6, inner[1] + 1e-6)
            around = [p for p in outer if holds(p[0], probe) or holds(p[0], (inner[0] - 1e-6, inner[1] - 1e-6))]
            min(around, key=lambda p: area(p[0])).append(hole)
        return outer
    inside = lambda a, b: a is not b and holds(b[0], (a[0][0][0] + 1e-6, a[0][0][1] + 1e-6)) and area(b[0]) > area(a[0])
    return [p for p in outer if not any(inside(p, q) for q in outer)]


def wkt(mask: np.ndarray, place=lambda x, y: (x, y), simplify: float = 0.0, keep_holes: bool = False) -> str | None:
    """POLYGON or MULTIPOLYGON of a mask with corners moved by the affine place(x, y); None for no pixel."""
    return wkts(mask, [place], simplify, keep_holes)[0]


def wkts(mask: np.ndarray, places: list, simplify: float = 0.0, keep_holes: bool = False) -> list[str | None]:
    """The same for several places, simplified in each: the mask is traced once."""
    found, out = polygons(mask, keep_holes), []
    for place in places:
        thin, parts = iter(simplified([ring for polygon in found for ring in polygon], simplify, place)), []
        for polygon in found:
            rings = [[place(*p) for p in next(thin)] for _ in polygon]
            parts.append("(" + ", ".join("(" + ", ".join(f"{x:.16f} {y:.16f}" for x, y in [*r, r[0]]) + ")" for r in rings) + ")")
        out.append(None if not parts else f"POLYGON {parts[0]}" if len(parts) == 1 else f"MULTIPOLYGON ({', '.join(parts)})")
    return out

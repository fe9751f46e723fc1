"""NumPy kernels for what one image needs iteratively: components, thinning, hulls, contours, homology.

All take one image (or one region's bounding-box crop) and hold nothing else.
"""

from __future__ import annotations

import numpy as np


def shifted(mask: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """mask read at (y + dy, x + dx), False beyond the frame."""
    h, w = mask.shape
    out = np.zeros_like(mask)
    if abs(dy) < h and abs(dx) < w:
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = mask[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def count_neighbours(mask: np.ndarray) -> np.ndarray:
    return sum(shifted(mask, dy, dx).astype(np.int8) for dy, dx in AROUND)


def components(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Labels 1..n of the connected components, in raster order of their first pixels.

    Works on the runs of each row: overlapping runs of neighbouring rows are united.
    """
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1] - 1
    n = len(row)
    out = np.zeros((h, w), np.int32)
    if not n:
        return out, 0
    stride, reach = w + 4, int(diagonal)
    lo = np.searchsorted(row * stride + end + 1, (row + 1) * stride + start + 1 - reach, "left")
    hi = np.searchsorted(row * stride + start + 1, (row + 1) * stride + end + 1 + reach, "right")
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
        for j in range(a, b):
            p, q = find(i), find(j)
            if p != q:
                parent[max(p, q)] = min(p, q)
    roots = np.array([find(i) for i in range(n)])
    number = np.unique(roots, return_inverse=True)[1] + 1  # roots are first runs, so in raster order
    lengths = end - start + 1
    at = np.repeat(row * w + start - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    out.ravel()[at] = np.repeat(number, lengths)
    return out, int(number.max())


def keep_large(mask: np.ndarray, least: int, diagonal: bool = False) -> np.ndarray:
    label, n = components(mask, diagonal)
    size = np.bincount(label.ravel(), minlength=n + 1)
    size[0] = 0
    return size[label] >= max(least, 1)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Background that no 4-connected path links to the frame's edge is filled."""
    label, n = components(~mask, diagonal=False)
    rim = np.unique(np.concatenate((label[0], label[-1], label[:, 0], label[:, -1])))
    outside = np.zeros(n + 1, bool)
    outside[rim] = True
    outside[0] = False
    return ~outside[label]


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    out = mask.copy()
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if 0 < dy * dy + dx * dx <= radius * radius:
                out |= shifted(mask, dy, dx)
    return out


def inner_boundary(labels: np.ndarray) -> np.ndarray:
    """Region pixels with a 4-neighbour of another label (background included)."""
    out = np.zeros(labels.shape, bool)
    down, across = labels[1:] != labels[:-1], labels[:, 1:] != labels[:, :-1]
    out[1:] |= down
    out[:-1] |= down
    out[:, 1:] |= across
    out[:, :-1] |= across
    return out & (labels > 0)


def thin(mask: np.ndarray) -> np.ndarray:
    """Zhang and Suen's thinning (1984): two sub-iterations until nothing changes."""
    m = mask.copy()
    while True:
        before = int(m.sum())
        for odd in (True, False):
            p2, p3, p4, p5, p6, p7, p8, p9 = (shifted(m, *o) for o in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)))
            ring = (p2, p3, p4, p5, p6, p7, p8, p9)
            around = sum(p.astype(np.int8) for p in ring)
            turns = sum((~a & b).astype(np.int8) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
            if odd:
                free = ~(p2 & p4 & p6) & ~(p4 & p6 & p8)
            else:
                free = ~(p2 & p4 & p8) & ~(p2 & p6 & p8)
            m = m & ~(m & (around >= 2) & (around <= 6) & (turns == 1) & free)
        if int(m.sum()) == before:
            return m


def boundary_classes(
    labels: np.ndarray, min_background: int = 100, thin_distance: int = 3, junction_radius: int = 3, min_thin: int = 10, min_junction: int = 50, clearance: int = 5
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label rasters of the large background areas, thin walls and junctions."""
    background = keep_large(labels == 0, min_background, diagonal=True)
    numbered, n = components(background)
    if not n:
        return numbered, np.zeros_like(numbered), np.zeros_like(numbered)
    skeleton = thin(background)
    crossings = skeleton & (count_neighbours(skeleton) >= 3)
    near_crossing = dilate(crossings, junction_radius)
    narrow = dilate(~background, thin_distance)
    walls = keep_large(background & narrow & ~near_crossing, min_thin)
    junctions = keep_large(background & (~narrow | near_crossing), min_junction)
    walls = fill_holes(walls & ~dilate(junctions, clearance))
    return numbered, components(keep_large(walls, min_thin))[0], components(keep_large(junctions, min_junction))[0]


def hull(points: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull (monotone chain), counter-clockwise, of (n, 2) points."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(seq) -> list:
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    seq = p.tolist()
    return np.array(half(seq) + half(seq[::-1]))


def _edge_points(mask: np.ndarray) -> np.ndarray:
    """Midpoints between a region's pixels and 4-neighbours outside it."""
    out = []
    for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)):
        y, x = np.nonzero(mask & ~shifted(mask, dy, dx))
        out.append(np.column_stack((y + dy / 2, x + dx / 2)))
    return np.vstack(out)


def convex_area(mask: np.ndarray) -> tuple[int, float]:
    """Pixels inside the hull of the pixels' side midpoints, and the hull's largest diameter."""
    corners = hull(_edge_points(mask))
    y, x = np.indices(mask.shape)
    inside = np.ones(mask.shape, bool)
    for a, b in zip(corners, np.roll(corners, -1, axis=0), strict=True):
        inside &= (b[0] - a[0]) * (x - a[1]) - (b[1] - a[1]) * (y - a[0]) >= -1e-9
    rim = hull(_edge_points(inside))
    d = rim[:, None, :] - rim[None, :, :]
    return int(inside.sum()), float(np.sqrt((d * d).sum(-1).max()))


#: Marching-squares segments by corner code (1, 2, 4, 8: upper left, upper right,
#: lower left, lower right inside); sides t, b, l, r; low values are fully connected.
SEGMENTS = {
    1: ["tl"], 2: ["rt"], 3: ["rl"], 4: ["lb"], 5: ["tb"], 6: ["rt", "lb"], 7: ["rb"],
    8: ["br"], 9: ["tl", "br"], 10: ["bt"], 11: ["bl"], 12: ["lr"], 13: ["tr"], 14: ["lt"],
}


def first_contour(mask: np.ndarray) -> np.ndarray | None:
    """The 0.5-level contour that starts first in raster order, as (n, 2) points; None without one."""
    h, w = mask.shape
    if h < 2 or w < 2:
        return None
    m = mask.astype(np.int8)
    code = m[:-1, :-1] + 2 * m[:-1, 1:] + 4 * m[1:, :-1] + 8 * m[1:, 1:]
    ys, xs = np.nonzero((code > 0) & (code < 15))
    if not len(ys):
        return None
    follow, lead, first = {}, {}, None
    for y, x in zip(ys.tolist(), xs.tolist(), strict=True):
        side = {"t": (2 * y, 2 * x + 1), "b": (2 * y + 2, 2 * x + 1), "l": (2 * y + 1, 2 * x), "r": (2 * y + 1, 2 * x + 2)}
        for s in SEGMENTS[int(code[y, x])]:
            a, b = side[s[0]], side[s[1]]
            follow[a], lead[b] = b, a
            first = first or a
    start = first
    while start in lead and lead[start] != first:
        start = lead[start]
    if start in lead:  # closed
        start = first
    path = [start]
    while path[-1] in follow:
        path.append(follow[path[-1]])
        if path[-1] == start:
            break
    return np.array(path, float) / 2


def curvature(c: np.ndarray) -> np.ndarray:
    """Unsigned curvature along a polyline of (y, x) points; zeros below three points."""
    if len(c) < 3:
        return np.zeros(len(c))
    dy, dx = np.gradient(c[:, 0]), np.gradient(c[:, 1])
    bottom = np.maximum((dx * dx + dy * dy) ** 1.5, 1e-9)
    return np.nan_to_num(np.abs(dx * np.gradient(dy) - dy * np.gradient(dx)) / bottom, nan=0.0, posinf=0.0, neginf=0.0)


def tortuosity(c: np.ndarray) -> float:
    if len(c) < 2:
        return 0.0
    length = float(np.hypot(*np.diff(c, axis=0).T).sum())
    chord = float(np.hypot(*(c[0] - c[-1])))
    if chord >= 1e-6:
        return length / chord
    return length / 1e-6 if length > 1e-6 else 1.0


def fourier_energy(c: np.ndarray, harmonics: int = 10) -> float:
    """Share of the last harmonics in the energy of x + iy without its mean."""
    if len(c) < 2:
        return 0.0
    energy = np.abs(np.fft.fft(c[:, 1] + 1j * c[:, 0])) ** 2
    total, take = float(energy[1:].sum()), min(harmonics, (len(energy) - 1) // 2)
    return float(energy[-take:].sum()) / total if total >= 1e-9 and take > 0 else 0.0


def box_dimension(mask: np.ndarray, scales: int = 10) -> float:
    """Box-counting slope of a region's crop, boxes from its corner; 0 with fewer than two scales.

    Scales are spaced evenly in the logarithm up to the longer side; those beyond the shorter
    side are left out.
    """
    h, w = mask.shape
    if max(h, w) <= 1:
        return 0.0
    every = np.unique(np.rint(10 ** (np.log10(float(max(h, w))) * np.arange(scales) / (scales - 1))).astype(int))
    used = every[every <= min(h, w)]
    if len(used) < 2:
        return 0.0
    y, x = np.nonzero(mask)
    counts = [np.count_nonzero(np.bincount((y // s) * (w + 1) + x // s)) for s in used.tolist()]
    a, b = np.log(used), np.log(counts)
    a = a - a.mean()
    return float(-(a @ (b - b.mean())) / (a @ a))


#: Border-pixel codes (1 + 2 per 4-neighbour + 10 per diagonal neighbour) and weights.
BORDER_WEIGHTS = {1.0: (5, 7, 15, 17, 25, 27), 2**0.5: (21, 33), (1 + 2**0.5) / 2: (13, 23)}


def perimeters(labels: np.ndarray) -> np.ndarray:
    """Perimeter of each label 0..max by the weights of its border pixels (Benkrid and Crookes)."""

    def at(raster: np.ndarray, dy: int, dx: int) -> np.ndarray:
        out = np.zeros_like(raster)
        h, w = raster.shape
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = raster[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
        return out

    inner = np.logical_and.reduce([at(labels, dy, dx) == labels for dy, dx in AROUND if not (dy and dx)])
    border = np.where(inner, 0, labels)
    code = np.ones(labels.shape, int)
    for dy, dx in AROUND:
        code += np.where(at(border, dy, dx) == border, 10 if dy and dx else 2, 0)
    weight = np.zeros(64)
    for value, codes in BORDER_WEIGHTS.items():
        weight[list(codes)] = value
    on = border > 0
    return np.bincount(border[on], weight[code[on]], minlength=int(labels.max(initial=0)) + 1)


def region_shape(mask: np.ndarray) -> dict[str, float]:
    """Hull, skeleton and contour features of one region's crop."""
    area = int(mask.sum())
    hull_area, feret = convex_area(mask)
    out = {"convexity": area / hull_area if hull_area else 0.0, "convex_defect": (max(hull_area, area) - area) / area, "feret_diameter_max": feret}
    out["skeleton_branches"], out["skeleton_length_ratio"] = 0.0, 0.0
    if area > 4:
        s = thin(mask)
        out["skeleton_branches"], out["skeleton_length_ratio"] = float((s & (count_neighbours(s) > 2)).sum()), float(s.sum()) / area
    c = first_contour(mask)
    k = curvature(c) if c is not None else np.zeros(0)
    out["tortuosity"] = tortuosity(c) if c is not None else 0.0
    out["curvature_std"] = float(k.std()) if c is not None and len(c) >= 3 else 0.0
    out["fourier_energy"] = fourier_energy(c) if c is not None else 0.0
    out["fractal_dimension_boxcount"] = box_dimension(mask)
    out["curvature_sum"], out["curvature_points"] = float(k.sum()), float(len(k))
    return out


def crops(labels: np.ndarray):
    """(label, y0, x0, mask) of each region's bounding box, by label."""
    ys, xs = np.nonzero(labels)
    if not len(ys):
        return
    of = labels[ys, xs]
    order = np.argsort(of, kind="stable")
    ys, xs, of = ys[order], xs[order], of[order]
    edge = np.flatnonzero(np.diff(of)) + 1
    for part in np.split(np.arange(len(of)), edge):
        y, x = ys[part], xs[part]
        y0, x0 = int(y.min()), int(x.min())
        mask = np.zeros((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), bool)
        mask[y - y0, x - x0] = True
        yield int(of[part[0]]), y0, x0, mask


def homology(y: np.ndarray, x: np.ndarray, limit: float = 100.0) -> tuple[list[tuple[float, float]], list[tuple[float, float]]]:
    """Finite bars of positive length of the Rips filtration up to limit, dimensions 0 and 1.

    Columns are integers with a bit per edge; a triangle's column is reduced by those with the
    same highest bit, which is the edge whose loop it closes.
    """
    n = len(y)
    i, j = np.triu_indices(n, 1)
    d = np.hypot(y[i] - y[j], x[i] - x[j])
    order = np.lexsort((j, i, d))
    order = order[d[order] <= limit]
    i, j, d = i[order], j[order], d[order]
    parent = list(range(n))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    zero, loops, number = [], 0, np.full((n, n), -1, np.int64)
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        number[a, b] = number[b, a] = k
        p, q = find(a), find(b)
        if p == q:
            loops += 1
        else:
            parent[max(p, q)] = min(p, q)
            if d[k] > 0:
                zero.append((0.0, float(d[k])))
    one, pivot = [], {}
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        if len(pivot) == loops:
            break
        # triangles whose longest edge is k enter with it
        third = np.flatnonzero((number[a] >= 0) & (number[b] >= 0) & (number[a] < k) & (number[b] < k))
        for c in third.tolist():
            column = 1 << k | 1 << int(number[a, c]) | 1 << int(number[b, c])
            while column:
                top = column.bit_length() - 1
                other = pivot.get(top)
                if other is None:
                    pivot[top] = column
                    if d[k] > d[top]:
                        one.append((float(d[top]), float(d[k])))
                    break
                column ^= other
    return zero, one


def _largest(a: np.ndarray) -> np.ndarray:
    """The adjacency matrix of the largest component (the first among equals)."""
    n, left, best = len(a), np.ones(len(a), bool), np.zeros(0, int)
    while left.any():
        seen = np.zeros(n, bool)
        seen[np.flatnonzero(left)[0]] = True
        while True:
            more = seen | a[seen].any(axis=0)
            if (more == seen).all():
                break
            seen = more
        left &= ~seen
        if seen.sum() > len(best):
            best = np.flatnonzero(seen)
    return a[np.ix_(best, best)]


def mean_clustering(a: np.ndarray) -> float:
    k = a.sum(axis=1)
    m = a.astype(float)
    t = np.einsum("ij,ji->i", m @ m, m)
    return float(np.where(k >= 2, t / np.maximum(k * (k - 1), 1), 0.0).mean()) if len(a) else 0.0


def mean_path(a: np.ndarray) -> float:
    """Mean shortest path over ordered pairs of a connected graph."""
    n = len(a)
    reach, total, step = np.eye(n, dtype=bool), 0, 0
    while not reach.all():
        step += 1
        more = reach | ((reach.astype(np.int32) @ a.astype(np.int32)) > 0)
        if (more == reach).all():
            break
        total += step * int(more.sum() - reach.sum())
        reach = more
    return total / (n * (n - 1)) if n > 1 else 0.0


def small_world(n: int, src: np.ndarray, dst: np.ndarray, seed: int) -> bool:
    """Whether the largest component clusters more than a random graph of its density (seeded)
    and has paths less than twice as long."""
    if n < 2 or not len(src):
        return False
    a = np.zeros((n, n), bool)
    a[src, dst] = a[dst, src] = True
    g = _largest(a)
    k = len(g)
    if k < 2:
        return False
    p = g.sum() / (k * (k - 1))
    upper = np.triu(np.random.default_rng(seed).random((k, k)) < p, 1)
    r = _largest(upper | upper.T)
    if len(r) < 2:
        return False
    rc, rl = mean_clustering(r), mean_path(r)
    return bool(rc > 1e-6 and rl > 1e-6 and mean_clustering(g) > rc and mean_path(g) < 2 * rl)


def deduplicate(masks: list[np.ndarray], min_area: int = 100, area_ratio: float | None = None) -> list[tuple[int, np.ndarray]]:
    """(index, pixels left) of the masks kept: larger ones claim first, small remainders claim nothing.

    Masks of another shape than the first are left out.
    """
    if not masks:
        return []
    shape = masks[0].shape
    least = min_area if area_ratio is None else max(min_area, int(shape[0] * shape[1] * area_ratio))
    taken, out = np.zeros(shape, bool), []
    for i in sorted((i for i, m in enumerate(masks) if m.shape == shape), key=lambda i: -int(masks[i].sum())):
        rest = masks[i] & ~taken
        if rest.sum() >= least:
            taken |= rest
            out.append((i, rest))
    return out


def skeleton_graph(s: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[tuple[int, int]]]]]:
    """Nodes (branch and end pixels) of a skeleton and its segments: (node, node, pixels after the first node).

    Each segment is followed through the pixels between nodes, which have two neighbours each, and
    is listed once, from its first node in raster order; several between the same nodes and those
    that return to their node are all listed. A ring without a node is no part of the graph.
    """
    k = count_neighbours(s)
    nodes = [tuple(p) for p in np.argwhere(s & ((k > 2) | (k == 1))).tolist()]
    number = {p: i for i, p in enumerate(nodes)}
    on = {tuple(p) for p in np.argwhere(s).tolist()}
    used, segments = set(), []
    for i, origin in enumerate(nodes):
        for dy, dx in AROUND:
            before, at = origin, (origin[0] + dy, origin[1] + dx)
            if at not in on or at in used or number.get(at, i) < i:
                continue
            path = [at]
            while at not in number:
                used.add(at)
                before, at = at, next(q for q in ((at[0] + a, at[1] + b) for a, b in AROUND) if q in on and q != before)
                path.append(at)
            segments.append((i, number[at], path))
    return nodes, segments

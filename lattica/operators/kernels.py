"""Sequential algorithms on the voxels of one group, in numpy; no Spark here."""

from __future__ import annotations

import heapq

import numpy as np

OFFSETS_26 = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
FACES = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]
FAR = 2**40


def lower_envelope(f: np.ndarray, squared: int = 1) -> np.ndarray:
    """min over q of (p - q)^2 * squared + f(q) for each p; f holds whole numbers, FAR where nothing is."""
    known = np.flatnonzero(f < FAR)
    n = len(f)
    if not len(known):
        return np.full(n, FAR, dtype=np.int64)
    hull, from_ = [int(known[0])], [-np.inf]
    for q in known[1:].tolist():
        while True:
            v = hull[-1]
            s = ((f[q] - f[v]) / squared + q * q - v * v) / (2 * (q - v))
            if s > from_[-1] or len(hull) == 1:
                break
            hull.pop()
            from_.pop()
        if s <= from_[-1]:
            hull[-1] = q
        else:
            hull.append(q)
            from_.append(s)
    at = np.searchsorted(np.array(from_), np.arange(n), side="left") - 1
    v = np.array(hull)[np.maximum(at, 0)]
    return (np.arange(n) - v) ** 2 * squared + f[v]


def squared_distance(cost: np.ndarray) -> np.ndarray:
    """Separable exact distance transform of any number of axes: min over all places of squared distance + cost."""
    out = cost.astype(np.int64)
    for axis in range(out.ndim):
        lines = np.moveaxis(out, axis, -1)
        out = np.moveaxis(envelopes(np.ascontiguousarray(lines).reshape(-1, lines.shape[-1])).reshape(lines.shape), -1, axis)
    return out


def envelopes(costs: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """`lower_envelope` of every row of a matrix of whole numbers, all rows at once."""
    n = costs.shape[1]
    if len(costs) > max(1, block // n):
        return np.concatenate([envelopes(costs[i : i + max(1, block // n)], block) for i in range(0, len(costs), max(1, block // n))])
    rows, top = np.arange(len(costs)), np.full(len(costs), -1)
    hull, begins = np.zeros(costs.shape, np.int64), np.full((len(costs), n + 1), np.inf)
    for q in range(n):
        todo = rows[costs[:, q] < FAR]
        if not len(todo):
            continue
        begin = np.full(len(costs), -np.inf)
        while len(todo):
            open_ = todo[top[todo] >= 0]
            v = hull[open_, top[open_]]
            begin[todo] = -np.inf
            begin[open_] = (costs[open_, q] + q * q - costs[open_, v] - v * v) / (2 * (q - v))
            todo = open_[begin[open_] <= begins[open_, top[open_]]]
            top[todo] -= 1
        put = rows[costs[:, q] < FAR]
        top[put] += 1
        hull[put, top[put]], begins[put, top[put]] = q, begin[put]
        begins[put, top[put] + 1] = np.inf
    out, at = np.full(costs.shape, FAR, np.int64), np.zeros(len(costs), np.int64)
    some = rows[top >= 0]
    for p in range(n):
        while len(on := some[(at[some] < top[some]) & (begins[some, np.minimum(at[some] + 1, n)] <= p)]):
            at[on] += 1
        v = hull[some, at[some]]
        out[some, p] = (p - v) ** 2 + costs[some, v]
    return out


def envelopes_of_runs(line: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """`lower_envelope` of each run of equal `line` numbers, over places that follow each other.

    Runs are put together by length, each to the next power of two.
    """
    starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    sizes = np.diff(np.r_[starts, len(line)])
    out = np.empty(len(costs), np.int64)
    widths = 1 << np.ceil(np.log2(sizes)).astype(np.int64)
    for width in np.unique(widths):
        own = widths == width
        at = starts[own][:, None] + np.arange(width)[None, :]
        real = np.arange(width)[None, :] < sizes[own][:, None]
        found = envelopes(np.where(real, costs[np.minimum(at, len(costs) - 1)], FAR))
        out[at[real]] = found[real]
    return out


def grid_of(points: np.ndarray, pad: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """A boolean box around points (n x 3) with `pad` empty voxels on all sides, and its corner."""
    low = points.min(axis=0) - pad
    box = np.zeros(points.max(axis=0) - low + pad + 1, dtype=bool)
    box[tuple((points - low).T)] = True
    return box, low


def boundary_distance(points: np.ndarray) -> np.ndarray:
    """Distance-from-boundary field at each point: voxels with an empty face neighbour have squared value 1."""
    box, low = grid_of(points)
    edge = np.zeros_like(box)
    for axis in range(3):
        for step in (-1, 1):
            edge |= box & ~np.roll(box, step, axis)
    own = tuple((points - low).T)
    inner, near = np.flatnonzero(~edge[own]), np.argwhere(edge | ~box)
    if len(inner) * len(near) <= 1 << 17:  # all pairs at once are less work than lines of a few places
        square = np.ones(len(points), np.int64)
        if len(inner):
            square[inner] = ((((points[inner] - low)[:, None] - near[None]) ** 2).sum(axis=2) + edge[tuple(near.T)]).min(axis=1)
        return np.sqrt(square.astype(np.float64))
    field = squared_distance(np.where(~box, 0, np.where(edge, 1, FAR)))
    return np.sqrt(field[own].astype(np.float64))


def geodesic(points: np.ndarray, penalty: np.ndarray, source: int) -> tuple[np.ndarray, np.ndarray]:
    """Dijkstra over 26-neighbours: distance and predecessor of each point (inf and -1 where unreached)."""
    index = {tuple(p): i for i, p in enumerate(points.tolist())}
    distance, before = np.full(len(points), np.inf), np.full(len(points), -1)
    distance[source] = 0.0
    steps = [(o, (o[0] ** 2 + o[1] ** 2 + o[2] ** 2) ** 0.5) for o in OFFSETS_26]
    heap, done = [(0.0, source)], np.zeros(len(points), dtype=bool)
    while heap:
        d, i = heapq.heappop(heap)
        if done[i]:
            continue
        done[i] = True
        z, y, x = points[i].tolist()
        for (a, b, c), length in steps:
            j = index.get((z + a, y + b, x + c))
            if j is not None and not done[j] and d + length + penalty[j] < distance[j]:
                distance[j], before[j] = d + length + penalty[j], i
                heapq.heappush(heap, (distance[j], j))
    return distance, before


def _near(reach: int, among) -> list[int]:
    """For each of the 26 offsets, a bit for each other one of `among` at most `reach` axis steps (26: any) away."""
    out = []
    for o in OFFSETS_26:
        gaps = [[abs(u - v) for u, v in zip(o, p, strict=True)] for p in OFFSETS_26]
        out.append(sum(1 << k for k, g in enumerate(gaps) if o in among and OFFSETS_26[k] in among and max(g) == 1 and sum(g) <= reach))
    return out


_EIGHTEEN = [o for o in OFFSETS_26 if sum(map(abs, o)) <= 2]
_BITS_18 = sum(1 << k for k, o in enumerate(OFFSETS_26) if o in _EIGHTEEN)
BITS_6 = sum(1 << k for k, o in enumerate(OFFSETS_26) if o in FACES)
_NEAR_26, _NEAR_6 = _near(3, OFFSETS_26), _near(1, _EIGHTEEN)


def _flooded(start: np.ndarray, masks: np.ndarray, near: list[int]) -> np.ndarray:
    """What `start` reaches inside of each mask, over offsets that are `near` each other."""
    reach = start
    while True:
        grown = reach.copy()
        for k, bits in enumerate(near):
            if bits:
                grown |= -(reach >> k & 1) & bits
        grown &= masks
        if (grown == reach).all():
            return reach
        reach = grown


def topology(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(simple, isthmus) of neighbourhoods with a bit for each of the 26 neighbours.

    Simple (26, 6): one part of neighbours, and one part of the background in the 18-neighbourhood that touches the
    middle by a face.  Isthmus: more than one part of neighbours.
    """
    own, place = np.unique(masks, return_inverse=True)
    whole = _flooded(own & -own, own, _NEAR_26) == own
    ground = ~own & _BITS_18
    faces = ground & BITS_6
    one = (faces != 0) & (faces & ~_flooded(faces & -faces, ground, _NEAR_6) == 0)
    return ((own != 0) & whole & one)[place], ((own != 0) & ~whole)[place]


class Box:
    """Labels of points at the places of a dense box; a point that is taken out leaves the background there.

    Where several labels have the same place, as cells of a coarser grid do, each label has a box of its own.
    """

    def __init__(self, points: np.ndarray, labels: np.ndarray | None = None, pad: int = 1):
        # `pad` places on all sides, so that no step of that length leads around to another row
        low = points.min(axis=0) - pad
        shape = points.max(axis=0) - low + pad + 1
        self.strides = (int(shape[1] * shape[2]), int(shape[2]), 1)
        self.at = (points - low) @ np.array(self.strides)
        self.codes = np.ones(len(points), np.int32) if labels is None else np.unique(labels, return_inverse=True)[1].astype(np.int32) + 1
        size = int(np.prod(shape))
        if labels is not None and len(np.unique(self.at)) < len(points):
            order, of = np.argsort(self.codes, kind="stable"), self.codes - 1
            first = np.searchsorted(self.codes[order], np.arange(1, of.max() + 2))
            low = np.minimum.reduceat(points[order], first) - pad
            shape = np.maximum.reduceat(points[order], first) - low + pad + 1
            ends = np.cumsum(shape.prod(axis=1))
            self.strides = ((shape[:, 1] * shape[:, 2])[of], shape[of, 2], 1)
            self.at = (ends - shape.prod(axis=1))[of] + sum(c * s for c, s in zip((points - low[of]).T, self.strides, strict=True))
            size = int(ends[-1])
        self.place = np.zeros(size, np.int32)
        self.place[self.at] = self.codes
        self.parity = (points & 1) @ np.array((4, 2, 1))

    def live(self) -> np.ndarray:
        return self.place[self.at] != 0

    def beside(self, rows: np.ndarray, offset) -> np.ndarray:
        """The places at an offset from the points."""
        z, y, _ = (s if np.isscalar(s) else s[rows] for s in self.strides)
        return self.at[rows] + (offset[0] * z + offset[1] * y + offset[2])

    def masks(self, rows: np.ndarray) -> np.ndarray:
        """A bit for each of the 26 neighbours that has the label of the point."""
        codes, out = self.codes[rows], np.zeros(len(rows), np.int64)
        for k, o in enumerate(OFFSETS_26):
            out |= (self.place[self.beside(rows, o)] == codes).astype(np.int64) << k
        return out


def thin_round(box: Box, frozen: np.ndarray | None) -> None:
    """One round of directional thinning, six sub-iterations; takes points out of the box.

    Border points of a direction that are simple are noted.  With `frozen`, curve thinning: isthmuses are marked there
    and stay for good.  Without, medial axis: points with fewer than two neighbours stay.  Noted points are checked
    again and taken out by the parity of their three coordinates, eight classes in turn: points of one class never
    touch, so that the order inside of a class doesn't matter, and what happens to a point depends on the
    REACH around it only.
    """
    for d in FACES:
        rows = np.flatnonzero(box.live())
        rows = rows[box.place[box.beside(rows, d)] != box.codes[rows]]
        if frozen is not None:
            rows = rows[~frozen[rows]]
        masks = box.masks(rows)
        simple, isthmus = topology(masks)
        if frozen is not None:
            frozen[rows[isthmus]] = True
        else:
            simple &= np.bitwise_count(masks) > 1
        noted = rows[simple]
        for parity in range(8):
            turn = noted[box.parity[noted] == parity]
            masks = box.masks(turn)
            goes = topology(masks)[0]
            if frozen is None:
                goes &= np.bitwise_count(masks) > 1
            box.place[box.at[turn[goes]]] = 0


#: How far on each axis a round sees: six directions, in each 1 for what is noted, and 1, 3 or 7 changes of parity.
REACH = (12, 24, 48)


def _thinned(points: np.ndarray, labels: np.ndarray | None, curve: bool) -> np.ndarray:
    box, frozen = Box(points, labels), np.zeros(len(points), bool) if curve else None
    left = len(points) + 1
    while (now := int(box.live().sum())) < left:
        left = now
        thin_round(box, frozen)
    return box.live()


def thin(points: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Mask of the points that stay after curve thinning: rounds until one takes nothing out."""
    return _thinned(points, labels, True)


def medial(points: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Mask of the points that stay on the medial axis: what directional thinning leaves when line ends are kept."""
    return _thinned(points, labels, False)


def few_neighbours(points: np.ndarray) -> np.ndarray:
    """Endpoints: at most 2 occupied voxels in the 3x3x3 around, the voxel itself counted."""
    index = {tuple(p) for p in points.tolist()}
    return np.array([1 + sum((p[0] + a, p[1] + b, p[2] + c) in index for a, b, c in OFFSETS_26) <= 2 for p in points.tolist()])


def parts_of(points: np.ndarray) -> np.ndarray:
    """26-connected component of each point, named by its first point."""
    index = {tuple(p): i for i, p in enumerate(points.tolist())}
    part = np.full(len(points), -1)
    for i in range(len(points)):
        if part[i] >= 0:
            continue
        part[i], stack = i, [i]
        while stack:
            z, y, x = points[stack.pop()].tolist()
            for a, b, c in OFFSETS_26:
                j = index.get((z + a, y + b, x + c))
                if j is not None and part[j] < 0:
                    part[j] = i
                    stack.append(j)
    return part


def settle(points: np.ndarray, labels: np.ndarray, penalty: np.ndarray, distance: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distances through 26-neighbours of equal label, from `distance` and what the points of `first` bring.

    A step costs its length and the penalty of the point that it enters.  Points that became nearer pass it on, all at
    once, until none does.
    """
    box, out = Box(points, labels), distance.copy()
    rows = np.full(len(box.place), -1, np.int64)
    rows[box.at] = np.arange(len(points))
    steps = [(o, (o[0] ** 2 + o[1] ** 2 + o[2] ** 2) ** 0.5) for o in OFFSETS_26]
    while len(first):
        to, cost = [], []
        for step, length in steps:
            other = rows[box.beside(first, step)]
            on = other >= 0
            on[on] = box.codes[other[on]] == box.codes[first[on]]
            new = out[first[on]] + length + penalty[other[on]]
            less = new < out[other[on]]
            to.append(other[on][less])
            cost.append(new[less])
        to, cost = np.concatenate(to), np.concatenate(cost)
        np.minimum.at(out, to, cost)
        first = np.unique(to)
    return out


def products_over(best: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """max of `best` and of one[i, t] * two[t, j] over all t."""
    out, two = best.copy(), np.ascontiguousarray(two)
    # so many rows at a time that these stay in a core's cache
    step = max(1, 2**15 // max(1, out.shape[1]))
    room = np.empty((step, out.shape[1]))
    for k in range(0, len(out), step):
        own, rows = out[k : k + step], one[k : k + step]
        over = room[: len(own)]
        for t in range(one.shape[1]):
            np.maximum(own, np.multiply(rows[:, t, None], two[t], out=over), out=own)
    return out


def best_products(m: np.ndarray) -> np.ndarray:
    """The largest product of factors of at most 1 along any path between two places of a square matrix."""
    out = m.copy()
    # over 64 places at a time, first between themselves, then from and to all places
    for k in range(0, len(out), 64):
        own = slice(k, k + 64)
        among = out[own, own].copy()
        for t in range(len(among)):
            np.maximum(among, among[:, t, None] * among[t], out=among)
        out[own], out[:, own] = products_over(out[own], among, out[own]), products_over(out[:, own], out[:, own], among)
        out = products_over(out, out[:, own], out[own])
    return out


def multiples(rows: np.ndarray, most: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scale, kind, units): each row is its scale times units[kind], up to a rounding of 1e-13 of each value.

    Rows that aren't multiples of one of the first `most` kinds are kinds of their own.
    """
    scale = rows.max(axis=1, initial=0.0)
    units = rows / np.where(scale > 0, scale, 1.0)[:, None]
    kind, first = np.full(len(rows), -1), []
    left = np.arange(len(rows))
    while len(left) and len(first) < most:
        own = units[left[0]]
        same = (np.abs(units[left] - own) <= 1e-13 * own).all(axis=1)
        kind[left[same]] = len(first)
        first.append(left[0])
        left = left[~same]
    kind[left] = np.arange(len(first), len(first) + len(left))
    return scale, kind, units[[*first, *left]]


def penalty_of(field: np.ndarray) -> np.ndarray:
    """5000 * (1 - DBF / max DBF)^16."""
    return 5000.0 * (1.0 - field / field.max()) ** 16


def teaser(points: np.ndarray, scale: float = 1.3, buffer: float = 2.0) -> np.ndarray:
    """Mask of skeleton points of one 26-connected component.

    Root: the last point reached from the first one by unpenalised steps.  Then, by penalised distance from
    the root, the farthest remaining point is traced back to the skeleton, and points within
    scale * DBF + buffer of the new path are taken out of the remaining ones.
    """
    field = boundary_distance(points)
    plain, _ = geodesic(points, np.zeros(len(points)), 0)
    root = int(np.flatnonzero(plain == plain.max())[-1])
    distance, before = geodesic(points, penalty_of(field), root)
    skeleton, left = np.zeros(len(points), dtype=bool), np.ones(len(points), dtype=bool)
    skeleton[root] = True
    left[((points - points[root]) ** 2).sum(axis=1) <= (scale * field[root] + buffer) ** 2] = False
    while left.any():
        i = int(np.argmax(np.where(left, distance, -1.0)))
        path = []
        while not skeleton[i]:
            path.append(i)
            i = int(before[i])
        skeleton[path] = True
        for j in path:
            left[((points - points[j]) ** 2).sum(axis=1) <= (scale * field[j] + buffer) ** 2] = False
    return skeleton


def pairs_within(points: list[tuple], reach: int) -> list[tuple[int, int]]:
    """Pairs i < j of points at most `reach` apart on each axis, through cells of that size."""
    cells: dict[tuple, list[int]] = {}
    size, out = reach + 1, []
    for j, p in enumerate(points):
        at = tuple(v // size for v in p)
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                for c in (-1, 0, 1):
                    out += [(i, j) for i in cells.get((at[0] + a, at[1] + b, at[2] + c), ()) if max(abs(u - v) for u, v in zip(points[i], p, strict=True)) <= reach]
        cells.setdefault(at, []).append(j)
    return out


def lonely(inside: set[tuple], points: list[tuple], reach: int = 3, expansion: float = 1.5, own: np.ndarray | None = None) -> np.ndarray:
    """Points with fewer than 2 others that are at most `reach` away on each axis and that A* reaches inside the set.

    A search goes from the earlier point to the later one.  Only pairs with a point of `own` are looked at, if given.
    """
    n = np.zeros(len(points), dtype=int)
    for i, j in pairs_within(points, reach):
        if (own is None or own[i] or own[j]) and has_path(inside, points[i], points[j], expansion):
            n[[i, j]] += 1
    return n < 2


def has_path(inside: set[tuple], a: tuple, b: tuple, expansion: float = 1.5) -> bool:
    """A* between two voxels inside a set of points; given up when the estimate passes expansion * first estimate.

    Steps and the estimate are squared Euclidean lengths.
    """
    h = lambda p: sum((u - v) ** 2 for u, v in zip(p, b, strict=True))
    first, heap, cost = h(a), [(h(a), 0, a)], {a: 0}
    while heap:
        f, g, p = heapq.heappop(heap)
        if p == b:
            return True
        if f > expansion * first:
            return False
        if g > cost[p]:
            continue
        for o in OFFSETS_26:
            q = (p[0] + o[0], p[1] + o[1], p[2] + o[2])
            step = g + o[0] ** 2 + o[1] ** 2 + o[2] ** 2
            if q in inside and step < cost.get(q, FAR):
                cost[q] = step
                heapq.heappush(heap, (step + h(q), step, q))
    return False


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a minimum-cost matching of all rows or all columns, whichever are fewer (shortest augmenting paths)."""
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j, way = i, 0, np.zeros(m + 1, dtype=int)
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j] = True
            row = match[j]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = c[row - 1, free - 1] - u[row] - v[free]
            better = reduced < least[free]
            least[free[better]] = reduced[better]
            way[free[better]] = j
            nxt = free[np.argmin(least[free])]
            delta = least[nxt]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j] = match[way[j]]
            j = way[j]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flipped else (a, b) for a, b in pairs)


def contract(edges: list[tuple[int, int, float]], lifted: list[tuple[int, int, float]] | None = None) -> dict[int, int]:
    """Greedy additive edge contraction: the root (smallest vertex) of each vertex.

    The heaviest positive edge is contracted, parallel edges add up, and so on; ties go to the smaller pair.
    With `lifted`, weights of both kinds add up but only pairs that have an original edge are contracted.
    """
    weight: dict[int, dict[int, float]] = {}
    real: dict[int, set[int]] = {}
    for kind, rows in ((True, edges), (False, lifted or [])):
        for a, b, w in rows:
            if a == b:
                continue
            for s, t in ((a, b), (b, a)):
                own = weight.setdefault(s, {})
                own[t] = own.get(t, 0.0) + w
                if kind:
                    real.setdefault(s, set()).add(t)
    root = {v: v for v in weight}
    heap = [(-w, a, b) for a in weight for b, w in weight[a].items() if a < b and b in real.get(a, ()) and w > 0]
    heapq.heapify(heap)
    while heap:
        w, a, b = heapq.heappop(heap)
        if b not in weight.get(a, ()) or weight[a][b] != -w or b not in real.get(a, ()):
            continue
        del weight[a][b]
        del weight[b][a]
        root[b] = a
        for t, x in weight.pop(b).items():
            del weight[t][b]
            weight[a][t] = weight[t][a] = weight[a].get(t, 0.0) + x
        for t in real.pop(b, set()):
            real[t].discard(b)
            if t != a:
                real[t].add(a)
                real[a].add(t)
        for t, x in weight[a].items():
            if x > 0 and t in real.get(a, ()):
                heapq.heappush(heap, (-x, *sorted((a, t))))

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    return {v: find(v) for v in root}


def contract_complete(one: np.ndarray, two: np.ndarray, weight: np.ndarray, original: np.ndarray) -> np.ndarray:
    """`contract` where every pair of vertices has a weight, on a matrix: whether each original pair is cut."""
    names, at = np.unique(np.concatenate([one, two]), return_inverse=True)
    i, j = np.sort(at.reshape(2, -1), axis=0)
    weights = np.zeros((len(names), len(names)))
    real = np.zeros(weights.shape, dtype=bool)
    weights[i, j] = weights[j, i] = weight
    real[i, j] = real[j, i] = original
    root, alive = np.arange(len(names)), np.ones(len(names), dtype=bool)
    first = original & (weight > 0)
    heap = list(zip((-weight[first]).tolist(), i[first].tolist(), j[first].tolist(), strict=True))
    heapq.heapify(heap)
    while heap:
        w, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or weights[a, b] != -w:
            continue
        alive[b] = False
        root[root == b] = a
        weights[a] += weights[b]
        weights[:, a] = weights[a]
        real[a] |= real[b]
        real[a, a] = False
        real[:, a] = real[a]
        for t in np.flatnonzero(real[a] & alive & (weights[a] > 0)).tolist():
            heapq.heappush(heap, (-float(weights[a, t]), *sorted((a, t))))
    return root[i[original]] != root[j[original]]

"""A navigable small-world graph over one shard, as flat arrays, in NumPy.

Points are numbered by falling level, so each layer holds a prefix of the points and is
one table of neighbour numbers, -1 where a row has fewer.  Layers are built from the top:
the points that also live above are linked by exact search, the others are inserted in
batches that search the layer built so far.  All searches advance many queries at once.
"""

from __future__ import annotations

import numpy as np

Layers = list[np.ndarray]


def _squares(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x - q
    return np.einsum("...i,...i->...", d, d)


def select(x: np.ndarray, number: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's candidates: first those nearer to the row's point than to
    any chosen before, so that links go out in all directions, then the nearest of the rest.

    ``number`` and ``dist`` are (rows, candidates); a missing candidate is -1 and infinite.
    """
    order = np.argsort(dist, axis=1, kind="stable")
    number, dist = np.take_along_axis(number, order, 1), np.take_along_axis(dist, order, 1)
    rows, many = number.shape
    some = x[np.maximum(number, 0)]
    flat = np.einsum("rci,rci->rc", some, some)
    apart = flat[:, :, None] + flat[:, None, :] - 2 * np.matmul(some, some.transpose(0, 2, 1))
    chosen = np.zeros((rows, many), bool)
    count = np.zeros(rows, np.int64)
    present = number >= 0
    for c in range(many):
        near = (chosen & (apart[:, c, :] < dist[:, c, None])).any(1)
        take = present[:, c] & ~near & (count < most)
        chosen[:, c] = take
        count += take
    rank = np.where(chosen, 0, np.where(present, 1, 2)) * many + np.arange(many)
    first = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(number, first, 1).astype(np.int32)


def beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, squared distances) of the ``width`` nearest points found for each query,
    sorted; -1 and infinite where fewer are found.

    ``entry`` holds each query's first point.  A query stops when the nearest point that was
    not expanded is farther than all it holds, or, given ``bound``, twice as far as what
    the caller could use (squared distances).
    """
    n, many = len(links), len(queries)
    seen = np.zeros((many, n + 1), bool)
    seen[:, n] = True
    number = np.full((many, width), -1, np.int64)
    dist = np.full((many, width), np.inf)
    done = np.ones((many, width), bool)
    number[:, 0], done[:, 0] = entry, False
    dist[:, 0] = _squares(x[entry], queries)
    seen[np.arange(many), entry] = True
    alive = np.arange(many)
    while len(alive):
        open_dist = np.where(done[alive], np.inf, dist[alive])
        best = open_dist.argmin(1)
        value = open_dist[np.arange(len(alive)), best]
        go = np.isfinite(value)
        if bound is not None:
            go &= (value <= 4 * bound[alive]) | (dist[alive, 0] >= value)
        alive, best = alive[go], best[go]
        if not len(alive):
            break
        done[alive, best] = True
        near = links[number[alive, best]].astype(np.int64)
        near[near < 0] = n
        rows = alive[:, None]
        fresh = ~seen[rows, near]
        seen[rows, near] = True
        worst = dist[alive, -1]
        d = np.full(near.shape, np.inf)
        r, c = np.nonzero(fresh)
        d[r, c] = _squares(x[near[r, c]], queries[alive[r]])
        better = (d < worst[:, None]).any(1)
        put = alive[better]
        if not len(put):
            continue
        all_d = np.concatenate([dist[put], d[better]], 1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        all_n = np.concatenate([number[put], near[better]], 1)
        all_done = np.concatenate([done[put], np.zeros((len(put), near.shape[1]), bool)], 1)
        dist[put] = np.take_along_axis(all_d, keep, 1)
        number[put] = np.take_along_axis(all_n, keep, 1)
        done[put] = np.take_along_axis(all_done, keep, 1) | ~np.isfinite(dist[put])
    number[~np.isfinite(dist)] = -1
    return number, dist


def _descend(x: np.ndarray, layers: Layers, queries: np.ndarray, down_to: int) -> np.ndarray:
    """The point of layer ``down_to`` + 1 from which each query enters layer ``down_to``."""
    entry = np.zeros(len(queries), np.int64)
    for layer in range(len(layers) - 1, down_to, -1):
        if layers[layer] is None:
            continue
        found, _ = beam(x, layers[layer], queries, entry, 4)
        entry = found[:, 0]
    return entry


def _exact(x: np.ndarray, points: np.ndarray, among: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` nearest others of each point by all distances, a block at a time."""
    numbers, dists = [], []
    for s in range(0, len(points), 256):
        p = points[s : s + 256]
        d = _squares(x[among][None, :, :], x[p][:, None, :])
        d[p[:, None] == among[None, :]] = np.inf
        k = min(most, d.shape[1])
        at = np.argpartition(d, k - 1, axis=1)[:, :k]
        dd = np.take_along_axis(d, at, 1)
        numbers.append(np.where(np.isfinite(dd), among[at], -1))
        dists.append(dd)
    return np.concatenate(numbers), np.concatenate(dists)


def _back_links(x: np.ndarray, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
    """Adds ``source`` to the rows ``target`` of ``links``; full rows keep a selection."""
    if not len(source):
        return
    order = np.lexsort((_squares(x[source], x[target]), target))
    source, target = source[order], target[order]
    rows, first, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, count)
    cap = links.shape[1]
    wide = np.full((len(rows), int(min(count.max(), 2 * cap))), -1, np.int64)
    fits = place < wide.shape[1]
    wide[np.repeat(np.arange(len(rows)), count)[fits], place[fits]] = source[fits]
    both = np.concatenate([links[rows].astype(np.int64), wide], 1)
    have = (both >= 0).sum(1)
    dist = np.where(both >= 0, _squares(x[np.maximum(both, 0)], x[rows][:, None, :]), np.inf)
    easy = have <= cap
    if easy.any():
        packed = np.take_along_axis(both[easy], np.argsort(both[easy] < 0, axis=1, kind="stable"), 1)[:, :cap]
        links[rows[easy]] = packed
    for s in range(0, int((~easy).sum()), 1024):
        part = np.flatnonzero(~easy)[s : s + 1024]
        links[rows[part]] = select(x, both[part], dist[part], cap)


def levels(uniform: np.ndarray, m: int) -> np.ndarray:
    """The level of each point from a number in (0, 1)."""
    return np.floor(-np.log(np.clip(uniform, 1e-12, 1 - 1e-12)) / np.log(m)).astype(np.int64)


def build(x: np.ndarray, level: np.ndarray, m: int = 12, width: int = 40, batch: int = 1024) -> Layers:
    """The layers, layer 0 first, of points already sorted by falling level."""
    n = len(x)
    top = int(level[0]) if n else 0
    size = [int((level >= t).sum()) for t in range(top + 1)]
    layers: Layers = [None] * (top + 1)
    for t in range(top, -1, -1):
        cap = 2 * m if t == 0 else m
        links = np.full((size[t], cap), -1, np.int32)
        above = size[t + 1] if t < top else 0
        ready = min(size[t], max(above, 256))
        known = np.arange(ready)
        for s in range(0, ready, batch):
            part = known[s : s + batch]
            number, dist = _exact(x, part, known, width)
            links[part, : min(m, number.shape[1])] = select(x, number, dist, m)
        r, c = np.nonzero(links[:ready] >= 0)
        _back_links(x, links, *_missing(links, r, links[r, c].astype(np.int64)))
        layers[t] = links
        while ready < size[t]:
            part = np.arange(ready, min(size[t], ready + min(batch, max(256, ready))))
            entry = _descend(x, layers, x[part], t)
            number, dist = beam(x, links[:ready], x[part], np.where(entry < ready, entry, 0), width)
            own_number, own_dist = _exact(x, part, part, min(width, len(part)))
            number, dist = np.concatenate([number, own_number], 1), np.concatenate([dist, own_dist], 1)
            keep = np.argsort(dist, axis=1, kind="stable")[:, :width]
            picked = select(x, np.take_along_axis(number, keep, 1), np.take_along_axis(dist, keep, 1), m)
            links[part, : picked.shape[1]] = picked
            r, c = np.nonzero(picked >= 0)
            _back_links(x, links, *_missing(links, part[r], picked[r, c].astype(np.int64)))
            ready = int(part[-1]) + 1
    return layers


def _missing(links: np.ndarray, source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links source -> target that have no link back yet."""
    lacks = ~(links[target] == source[:, None]).any(1)
    return source[lacks], target[lacks]


def search(x: np.ndarray, layers: Layers, queries: np.ndarray, k: int, width: int, bound: np.ndarray | None = None, batch: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, squared distances) of the k nearest points of each query."""
    numbers, dists = [np.zeros((0, k), np.int64)], [np.zeros((0, k))]
    for s in range(0, len(queries), batch):
        q = queries[s : s + batch]
        entry = _descend(x, layers, q, 0)
        number, dist = beam(x, layers[0], q, entry, max(width, k), None if bound is None else bound[s : s + batch])
        numbers.append(number[:, :k])
        dists.append(dist[:, :k])
    return np.concatenate(numbers), np.concatenate(dists)

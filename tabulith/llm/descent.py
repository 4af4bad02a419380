"""NN-descent and greedy search among vectors that are held in memory: one region of the index.

The graph starts from exact partners within the leaves of random-hyperplane trees and is improved by joins:
those that meet at a vector, its neighbours and those that it is a neighbour of, are compared where one of
the two is new there. Vectors are the rows of one matrix, and many are handled at a time.
"""

from __future__ import annotations

import numpy as np

#: Neighbours of a vector, trees, rows of a leaf, new and other vectors that meet at one in a round, links back that a walk sees.
K, TREES, LEAF, YOUNG, OLD, BACK = 32, 8, 256, 24, 16, 24
#: Rounds end when less than this share of the links changed.
SETTLED = 0.08
#: Pairs gathered before they are taken in; vectors whose meetings are compared at one; rows multiplied at one.
PAIRS, STEP, BLOCK = 3_000_000, 256, 1024
#: Vectors that every walk is compared with at its start, those of them that it starts from.
DOORS, ENTRIES = 1024, 8
#: Vectors that a walk keeps at first, walks that a beam is tried on, share of the best that these must find.
BEAM, TRIED, REACH = 48, 128, 0.93
#: Flags of vectors seen, of all walks under way at one.
SEEN = 16_000_000


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    """Unit vectors with one more component, whose cosines are in the order of the inner products of vectors up to the norm most."""
    v = v / most
    return np.column_stack((v, np.sqrt(np.maximum(1 - (v**2).sum(1), 0))))


def runs(sorted_owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each owner's run starts, the run of each entry and its place there."""
    first = np.flatnonzero(np.concatenate(([True], sorted_owner[1:] != sorted_owner[:-1]))) if len(sorted_owner) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(sorted_owner)))
    return first, np.repeat(np.arange(len(first)), count), np.arange(len(sorted_owner)) - np.repeat(first, count)


def _best(node: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's nodes the k best different ones, and their columns; -1 are none. Of equal nodes the first stays."""
    order = np.argsort(node, axis=1, kind="stable")
    node = np.take_along_axis(node, order, 1)
    bad = node < 0
    bad[:, 1:] |= node[:, 1:] == node[:, :-1]
    score = np.where(bad, -np.inf, np.take_along_axis(score, order, 1))
    at = np.argpartition(-score, k - 1, axis=1)[:, :k]
    score = np.take_along_axis(score, at, 1)
    return np.where(score > -np.inf, np.take_along_axis(node, at, 1), -1), score, np.take_along_axis(order, at, 1)


def _leaves(x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Places of rows in leaves of at most LEAF, by halving along random planes; equal rows are halved as well."""
    todo, out = [np.arange(len(x), dtype=np.int32)], []
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            out.append(own)
            continue
        order = own[np.argpartition(x[own] @ rng.normal(size=x.shape[1]).astype(np.float32), len(own) // 2)]
        todo += [order[: len(own) // 2], order[len(own) // 2 :]]
    return out


def _start(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    node, score = np.full((len(x), k), -1, np.int32), np.full((len(x), k), -np.inf, np.float32)
    for _ in range(TREES if len(x) > LEAF else 1):
        for own in _leaves(x, rng):
            m = min(k, len(own) - 1)
            if m > 0:
                s = x[own] @ x[own].T
                np.fill_diagonal(s, -np.inf)
                at = np.argpartition(-s, m - 1, axis=1)[:, :m]
                node[own], score[own], _ = _best(np.concatenate((node[own], own[at]), 1), np.concatenate((score[own], np.take_along_axis(s, at, 1)), 1), k)
    return node, score


def _some(owner: np.ndarray, other: np.ndarray, n: int, most: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """At most so many others of each of n owners, by luck, padded with -1, and the places of those entries."""
    order = np.argsort(owner.astype(np.int64) << 32 | rng.integers(0, 1 << 32, len(owner)))
    column = runs(owner[order])[2]
    order, column = order[column < most], column[column < most]
    out = np.full((n, most), -1, np.int32)
    out[owner[order], column] = other[order]
    return out, order


def _taken(node: np.ndarray, score: np.ndarray, fresh: np.ndarray, pairs: list[tuple[np.ndarray, ...]]) -> int:
    """Take in the better ones of the pairs (owner, other, score): how many there are."""
    u, v, s = (np.concatenate(c) for c in zip(*pairs, strict=True))
    k = node.shape[1]
    bits = s.view(np.int32).astype(np.int64)
    order = np.argsort((u.astype(np.int64) << 32) - np.where(bits < 0, -(bits & 0x7FFFFFFF), bits))  # an owner's best first
    u, v = u[order], v[order]
    once = np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])))
    u, v, s = u[once], v[once], s[order][once]
    first, row, column = runs(u)
    who, keep = u[first], column < k
    more, gain = np.full((len(who), k), -1, np.int32), np.full((len(who), k), -np.inf, np.float32)
    more[row[keep], column[keep]], gain[row[keep], column[keep]] = v[keep], s[keep]
    node[who], score[who], at = _best(np.concatenate((node[who], more), 1), np.concatenate((score[who], gain), 1), k)
    fresh[who] = np.take_along_axis(np.concatenate((fresh[who], np.ones(more.shape, bool)), 1), at, 1)
    return int(((at >= k) & (node[who] >= 0)).sum())


def _round(x: np.ndarray, node: np.ndarray, score: np.ndarray, fresh: np.ndarray, rng: np.random.Generator) -> int:
    """Compare what meets, and take in what is better. A link stays new until it was met at both of its ends."""
    r, c = np.nonzero(node >= 0)
    to, new = node[r, c], fresh[r, c]
    now, before = np.flatnonzero(new), np.flatnonzero(~new)
    young, met = _some(np.concatenate((r[now], to[now])), np.concatenate((to[now], r[now])), len(x), YOUNG, rng)
    old, _ = _some(np.concatenate((r[before], to[before])), np.concatenate((to[before], r[before])), len(x), OLD, rng)
    done = now[np.bincount(met % max(1, len(now)), minlength=len(now)) == 2]
    fresh[r[done], c[done]] = False
    worst, pairs, size, changed = score.min(1), [], 0, 0
    own = np.flatnonzero(young[:, 0] >= 0)
    for a in range(0, len(own), STEP):
        y = young[own[a : a + STEP]]
        both = np.concatenate((y, old[own[a : a + STEP]]), 1)
        g, w = x[both], worst[both]
        s = g[:, :YOUNG] @ g.transpose(0, 2, 1)
        ok = (y[:, :, None] >= 0) & (both[:, None, :] >= 0) & (y[:, :, None] != both[:, None, :])
        for turned, least in ((False, w[:, :YOUNG, None]), (True, w[:, None, :])):
            at = np.flatnonzero(ok & (s > least))
            rest, j = np.divmod(at, both.shape[1])
            b, i = np.divmod(rest, YOUNG)
            u, v = y[b, i], both[b, j]
            pairs.append((v, u, s.ravel()[at]) if turned else (u, v, s.ravel()[at]))
            size += len(at)
        if size >= PAIRS:
            changed += _taken(node, score, fresh, pairs)
            worst, pairs, size = score.min(1), [], 0
    return changed + (_taken(node, score, fresh, pairs) if size else 0)


def graph(x: np.ndarray, k: int = K) -> np.ndarray:
    """The neighbours of each row of x (unit vectors, 32 bits) by the largest products found, then some links back; -1 are none."""
    rng = np.random.default_rng(len(x))
    node, score = _start(x, k, rng)
    fresh, changed = node >= 0, len(x) * k
    while len(x) > LEAF and changed >= SETTLED * len(x) * k:
        changed = _round(x, node, score, fresh, rng)
    r, c = np.nonzero(node >= 0)
    return np.concatenate((node, _some(node[r, c], r, len(x), BACK, rng)[0]), 1)


def _products(x: np.ndarray, to: np.ndarray, y: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Inner products of the rows to of x and of of y, a cache's worth at a time."""
    out, a, b = np.empty(len(to), x.dtype), np.empty((BLOCK, x.shape[1]), x.dtype), np.empty((BLOCK, x.shape[1]), x.dtype)
    for i in range(0, len(to), BLOCK):
        m = len(to[i : i + BLOCK])
        np.take(x, to[i : i + m], axis=0, out=a[:m], mode="clip")
        np.take(y, of[i : i + m], axis=0, out=b[:m], mode="clip")
        np.einsum("ij,ij->i", a[:m], b[:m], out=out[i : i + m])
    return out


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, own: np.ndarray, beam: int) -> np.ndarray:
    """The beam best rows of x that a walk of each row of q met, best first; it starts from its own place (-1: none) and the best doors.

    A step opens the best vectors that are not open yet; a walk ends when all of its beam are.
    """
    n, beam, opened = len(x), min(beam, len(x)), max(8, beam // 8)
    doors = np.random.default_rng(n).permutation(n)[:DOORS]
    entries = min(ENTRIES, len(doors))
    out, size = np.full((len(q), beam), -1, np.int64), max(1, SEEN // n)
    seen = np.zeros((min(size, len(q)), n + 1), bool)
    for a in range(0, len(q), size):
        y = q[a : a + size]
        s = y @ x[doors].T
        want = np.concatenate((doors[np.argpartition(-s, entries - 1, axis=1)[:, :entries]], own[a : a + len(y), None]), 1)
        want[want < 0] = n
        seen[:] = False
        seen[:, n] = True  # no vector
        rows = np.arange(len(y))
        top, top_s, done = np.full((len(y), beam), n), np.full((len(y), beam), -np.inf, np.float32), np.ones((len(y), beam), bool)
        while len(rows):
            want = np.sort(want, axis=1)
            new = ~seen[rows[:, None], want]
            new[:, 1:] &= want[:, 1:] != want[:, :-1]
            r, c = np.nonzero(new)
            to = want[r, c]
            seen[rows[r], to] = True
            s = _products(x, to, y, rows[r])
            good = s > top_s[rows[r], -1]
            r, to, s = r[good], to[good], s[good]
            column = runs(r)[2]
            m = int(column.max(initial=-1)) + 1
            more, more_s, more_done = np.full((len(rows), m), n), np.full((len(rows), m), -np.inf, np.float32), np.ones((len(rows), m), bool)
            more[r, column], more_s[r, column], more_done[r, column] = to, s, False
            both = np.concatenate((top_s[rows], more_s), 1)
            order = np.argsort(-both, axis=1)[:, :beam]
            top[rows] = np.take_along_axis(np.concatenate((top[rows], more), 1), order, 1)
            top_s[rows] = np.take_along_axis(both, order, 1)
            open_ = np.take_along_axis(np.concatenate((done[rows], more_done), 1), order, 1)
            going = ~open_.all(1)
            rows, open_ = rows[going], open_[going]
            pick = np.argsort(open_, axis=1, kind="stable")[:, :opened]
            fine = ~np.take_along_axis(open_, pick, 1)
            np.put_along_axis(open_, pick, True, 1)
            done[rows] = open_
            want = links[np.minimum(np.take_along_axis(top[rows], pick, 1), n - 1)]
            want = np.where(fine[:, :, None] & (want >= 0), want, n).reshape(len(rows), pick.shape[1] * links.shape[1])
        out[a : a + len(y)] = np.where(top < n, top, -1)
    return out


def fitting_beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, own: np.ndarray, r: int, least: int) -> int:
    """The first of least, a third more, .. at which walks of some of q find REACH of their r best rows of x."""
    some = np.unique(np.linspace(0, len(q) - 1, TRIED).astype(np.int64))
    s, r, beam = q[some] @ x.T, min(r, len(x)), least
    want = np.argpartition(-s, r - 1, axis=1)[:, :r]
    while beam < len(x):
        got = walk(x, links, q[some], own[some], beam)
        if np.mean([np.isin(w, g).mean() for w, g in zip(want, got, strict=True)]) >= REACH:
            break
        beam = beam * 4 // 3
    return beam

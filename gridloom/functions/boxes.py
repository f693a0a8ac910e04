"""Box arithmetic in numpy for Arrow batches that hold many groups at once: no loop over groups or boxes, only over steps that all groups take together.

Arrays of boxes have x1, y1, x2, y2 along their last axis; two arrays are compared by numpy's broadcasting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs compared at a time, boxes of a group beyond which it is decided block by block, and pairs whose columns stay in a processor's cache.
PAIRS, BLOCK, CACHED = 1 << 20, 1024, 1 << 15
DROPPED, FREE, OPEN = 0, 1, 2


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As geometry.iou."""
    both, union = _overlap(a, b)
    return np.divide(both, union, out=np.zeros(both.shape), where=union > 0)


def diou(a: np.ndarray, b: np.ndarray, eps: float = 1e-7) -> np.ndarray:
    """As geometry.diou."""
    both, union = _overlap(a, b)
    gap = (b[..., 0] + b[..., 2]) / 2 - (a[..., 0] + a[..., 2]) / 2, (b[..., 1] + b[..., 3]) / 2 - (a[..., 1] + a[..., 3]) / 2
    hull = np.maximum(a[..., 2], b[..., 2]) - np.minimum(a[..., 0], b[..., 0]), np.maximum(a[..., 3], b[..., 3]) - np.minimum(a[..., 1], b[..., 1])
    return both / (union + eps) - (gap[0] * gap[0] + gap[1] * gap[1]) / (hull[0] * hull[0] + hull[1] * hull[1] + eps)


def _overlap(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = np.maximum(np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0]), 0)
    both = wide * np.maximum(np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1]), 0)
    return both, (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1]) + (a[..., 2] - a[..., 0]) * (a[..., 3] - a[..., 1]) - both


def clamped(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """IoU, and DIoU with a diagonal of at least 1e-6, negative sides counting as 0."""
    side = lambda p: np.clip(p[..., 2] - p[..., 0], 0, None) * np.clip(p[..., 3] - p[..., 1], 0, None)
    wide, high = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0]), np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    both = np.clip(wide, 0, None) * np.clip(high, 0, None)
    union = side(a) + side(b) - both
    iou = np.divide(both, union, out=np.zeros(both.shape), where=union > 0)
    gap = (a[..., :2] + a[..., 2:]) / 2 - (b[..., :2] + b[..., 2:]) / 2
    hull = np.clip(np.maximum(a[..., 2:], b[..., 2:]) - np.minimum(a[..., :2], b[..., :2]), 0, None)
    return iou, iou - (gap**2).sum(axis=-1) / np.maximum((hull**2).sum(axis=-1), 1e-6)


def ranges(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of the numbers low[i] to low[i] + n[i] - 1 of each owner i."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - (np.cumsum(n) - n)[owner] + low[owner]


def decide(boxes: np.ndarray, first: np.ndarray, sure: np.ndarray, single: np.ndarray, like: Callable, threshold: float) -> np.ndarray:
    """Verdicts on boxes in groups (which begin at `first`), in falling order in each; sure: kept before; single: in no other group. Of the boxes before it that are
    too like it, one that is kept drops a box, and one whose fate is open leaves it open."""
    out, size = np.full(len(boxes), FREE), np.diff(np.append(first, len(boxes)))
    small = np.flatnonzero(size <= BLOCK)
    _, rows = ranges(first[small], size[small])
    begin = np.cumsum(size[small]) - size[small]
    out[rows] = _settled(len(rows), *_alike(boxes[rows], np.repeat(begin + size[small], size[small]), like, threshold), sure[rows], single[rows])
    for g in np.flatnonzero(size > BLOCK):
        out[first[g] : first[g] + size[g]] = _in_blocks(*(x[first[g] : first[g] + size[g]] for x in (boxes, sure, single)), like, threshold)
    return out


def _alike(boxes: np.ndarray, end: np.ndarray, like: Callable, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of rows, b from a + 1 up to the end of a's group, that are more alike than the threshold."""
    after = end - np.arange(len(boxes)) - 1
    cuts = np.searchsorted(np.cumsum(after), np.arange(PAIRS, after.sum() + PAIRS, PAIRS)) + 1
    found, low = [], 0
    for high in np.minimum(cuts, len(boxes)):
        if low < high:
            a, b = ranges(np.arange(low, high) + 1, after[low:high])
            near = like(boxes[a + low], boxes[b]) > threshold
            found.append((a[near] + low, b[near]))
        low = high
    if not found:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _settled(n: int, a: np.ndarray, b: np.ndarray, sure: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Verdicts on n boxes from the pairs that are alike, the stronger first: each round settles all whose stronger ones are settled."""
    kept, left, out = sure.copy(), np.zeros(n, bool), np.where(sure, FREE, -1)
    while True:
        hit = b[kept[a]]
        out[hit[out[hit] < 0]] = DROPPED
        live = (out[b] < 0) & (out[a] != DROPPED)
        a, b = a[live], b[live]
        waits, opened = np.zeros(n, bool), np.zeros(n, bool)
        waits[b[out[a] < 0]] = True
        opened[b[left[a]]] = True
        now = (out < 0) & ~waits
        if not now.any():
            return out
        out[now] = np.where(opened[now], OPEN, FREE)
        kept |= now & ~opened & single
        left |= now & (opened | ~single)


def _in_blocks(boxes: np.ndarray, sure: np.ndarray, single: np.ndarray, like: Callable, threshold: float) -> np.ndarray:
    """Verdicts on one group of any size: a block meets what stands before it, then itself. Memory is bounded by a block and PAIRS."""
    out, kept, left = np.full(len(boxes), FREE), np.empty((0, 4)), np.empty((0, 4))

    def met(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(rows), bool)
        for at in range(0, len(others), PAIRS // BLOCK):
            hit |= (like(rows[:, None], others[None, at : at + PAIRS // BLOCK]) > threshold).any(axis=1)
        return hit

    for at in range(0, len(boxes), BLOCK):
        own, s, one = boxes[at : at + BLOCK], sure[at : at + BLOCK], single[at : at + BLOCK]
        gone, opened = met(own, kept) & ~s, met(own, left) & ~s
        rest = np.flatnonzero(~gone)
        a, b = _alike(own[rest], np.full(len(rest), len(rest)), like, threshold)
        # an open box before the block opens what it is like, unless a kept one of the block drops it: it is a first row that is sure to be left open
        n = len(rest)
        marks = np.flatnonzero(opened[rest])
        a, b = np.concatenate([a, np.full(len(marks), n)]), np.concatenate([b, marks])
        verdict = _settled_with_open(n, a, b, s[rest], one[rest])
        now = np.full(len(own), DROPPED)
        now[rest] = verdict
        out[at : at + BLOCK] = now
        stays = s | (one & (now == FREE))
        kept, left = np.concatenate([kept, own[stays]]), np.concatenate([left, own[~stays & (now != DROPPED)]])
    return out


def _settled_with_open(n: int, a: np.ndarray, b: np.ndarray, sure: np.ndarray, single: np.ndarray) -> np.ndarray:
    """As _settled, with one more box, numbered n, whose fate is open."""
    return _settled(n + 1, a, b, np.append(sure, False), np.append(single, False))[:n]


def most_alike(boxes: np.ndarray, rows: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, IoU) for each of these rows: of the n[i] boxes from low[i] on the one with the largest IoU (the first of equals), of those that overlap; -1 without one."""
    best, like = np.full(len(rows), -1), np.full(len(rows), -1.0)
    x1, y1, x2, y2 = np.ascontiguousarray(boxes.T)
    cuts = np.searchsorted(np.cumsum(n), np.arange(CACHED, n.sum() + CACHED, CACHED)) + 1
    begin = 0
    for end in np.minimum(cuts, len(rows)):
        if begin < end:
            own, size = rows[begin:end], n[begin:end]
            of, other = ranges(low[begin:end], size)
            near = np.flatnonzero((np.repeat(x1[own], size) < x2[other]) & (x1[other] < np.repeat(x2[own], size)))
            of, other = of[near], other[near]
            near = (y1[own[of]] < y2[other]) & (y1[other] < y2[own[of]])
            of, other = of[near], other[near]
            alike = iou(boxes[own[of]], boxes[other])
            if len(of):
                new = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                at = np.flatnonzero(alike == np.repeat(np.maximum.reduceat(alike, new), np.diff(np.append(new, len(of)))))
                at = at[np.append(True, of[at][1:] != of[at][:-1])[: len(at)]]
                best[begin + of[at]], like[begin + of[at]] = other[at], alike[at]
        begin = end
    return best, like


def largest_before(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each value the largest of those of its owner that stand before it, -1 without one; by doubling steps, so that an owner may have any number of them."""
    order = np.argsort(owner, kind="stable")
    own, top = owner[order], values[order]
    place = np.arange(len(own)) - np.searchsorted(own, own)
    step = 1
    while step <= place.max(initial=0):
        at = np.flatnonzero(place >= step)
        top[at] = np.maximum(top[at], top[at - step])
        step *= 2
    out = np.full(len(own), -1.0)
    later = np.flatnonzero(place)
    out[order[later]] = top[later - 1]
    return out


def adaptive(boxes: np.ndarray, scores: np.ndarray, first: np.ndarray, tau: float, k: int, alpha: float, least: float, duplicate: float, ratio: float) -> np.ndarray:
    """Rows that suppression.adaptive_nms keeps of groups in falling order; each step takes the best box that is left of every group."""
    left = np.arange(len(boxes))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(boxes))))
    kept = []
    while len(left):
        own = group[left]
        head = np.append(True, own[1:] != own[:-1])
        best = left[head]
        kept.append(best)
        n = np.diff(np.append(np.flatnonzero(head), len(left))) - 1
        best, n, left = best[n > 0], n[n > 0], left[~head]
        if not len(left):
            break
        of = np.repeat(np.arange(len(n)), n)
        _, alike = clamped(boxes[best[of]], boxes[left])
        order = np.lexsort((-alike, of))
        place = np.arange(len(left)) - (np.cumsum(n) - n)[of]
        top, at = np.zeros((len(n), k)), place < k
        top[of[at], place[at]] = alike[order[at]]
        total = np.zeros(len(n))
        for i in range(k):
            total += top[:, i]
        cut = np.maximum(least, tau - alpha * (total / np.minimum(n, k)))
        left = left[~((alike > cut[of]) | ((alike > duplicate) & (scores[left] >= ratio * scores[best[of]])))]
    return np.sort(np.concatenate(kept)) if kept else left


def fused(boxes: np.ndarray, scores: np.ndarray, first: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, boxes, scores) of suppression.wbf's fused boxes of groups in falling order, a row being that of the first box in each; step i takes every group's box i."""
    size = np.diff(np.append(first, len(boxes)))
    n_fused, row = np.zeros(len(first), int), np.zeros(len(boxes), int)
    mean, sums, weight, members = np.zeros((len(boxes), 4)), np.zeros((len(boxes), 4)), np.zeros(len(boxes)), np.zeros(len(boxes), int)
    for i in range(size.max(initial=0)):
        live = np.flatnonzero(size > i)
        own = first[live] + i
        of, slot = ranges(first[live], n_fused[live])
        at, joins = first[live] + n_fused[live], np.zeros(len(live), bool)
        if len(of):
            like = clamped(boxes[own[of]], mean[slot])[0]
            top = np.maximum.reduceat(like, np.cumsum(n_fused[live]) - n_fused[live])
            joins = top > threshold
            is_top = np.flatnonzero(like == top[of])
            who, where = np.unique(of[is_top], return_index=True)  # the first of equals
            nearest = at.copy()
            nearest[who] = slot[is_top[where]]
            at = np.where(joins, nearest, at)
        row[at[~joins]] = own[~joins]
        n_fused[live[~joins]] += 1
        sums[at] += boxes[own] * scores[own, None]
        weight[at] += scores[own]
        members[at] += 1
        mean[at] = np.where(joins[:, None], sums[at] / np.where(joins, weight[at], 1.0)[:, None], boxes[own])
    _, slots = ranges(first, n_fused)
    return row[slots], mean[slots], weight[slots] / np.maximum(members[slots], 1)


def changes(columns: list) -> np.ndarray:
    """Whether each row but the first differs from the one before it in any column (Arrow arrays); nulls are equal."""
    new = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        a, b = c[1:], c[:-1]
        differs = pc.fill_null(pc.not_equal(a, b), False)
        new |= np.asarray(pc.or_(differs, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False), bool)
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, where groups begin) of batches sorted by keys, each with whole groups; a group may go on over any number of batches."""
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        (rows,) = pa.Table.from_batches(parts).combine_chunks().to_batches()
        return rows, np.append(0, np.flatnonzero(changes([rows.column(k) for k in keys])) + 1)

    for batch in batches:
        if not batch.num_rows:
            continue
        last = held[-1].slice(held[-1].num_rows - 1) if held else batch.slice(0, 1)
        seen = [pa.concat_arrays([last.column(k), batch.column(k)]) for k in keys]
        cuts = np.flatnonzero(changes(seen))
        if len(cuts):
            cut = int(cuts[-1])
            yield joined([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield joined(held)


def edges(rows: pa.RecordBatch) -> np.ndarray:
    return np.stack([rows.column(e).to_numpy(zero_copy_only=False).astype(float) for e in ("x1", "y1", "x2", "y2")], axis=1)

"""Edit distances of many keys at once: bit-parallel columns (Myers), a vector of pairs at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Pairs in a vector; rows of a batch that goes back to Spark.
VECTOR, BATCH = 1 << 16, 50_000


def bound(n: int) -> int:
    return n * 18 // 100


def matrix(keys: list[str], n: int) -> np.ndarray:
    """Code points of keys of ``n`` characters each."""
    return np.frombuffer("".join(keys).encode("utf-32-le"), "<u4").reshape(len(keys), n) if n else np.empty((len(keys), 0), "<u4")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Columns in front that are the same in all rows of both."""
    n = min(a.shape[1], b.shape[1])
    same = (a[:, :n] == a[0, :n]).all(0) & (b[:, :n] == a[0, :n]).all(0)
    return n if same.all() else int(same.argmin())


def near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """For each row of ``a`` and each of ``b`` whether their edit distance is at most ``most``."""
    p = _common(a, b)
    a, b = a[:, p:], b[:, p:]
    p = _common(a[:, ::-1], b[:, ::-1])
    a, b = a[:, : a.shape[1] - p], b[:, : b.shape[1] - p]
    m, n = a.shape[1], b.shape[1]
    if not m or not n:
        return np.full((len(a), len(b)), max(m, n) <= most)
    letters, codes = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    a, b = codes[: a.size].reshape(a.shape), np.ascontiguousarray(codes[a.size :].reshape(b.shape).T)
    out = np.empty((len(a), b.shape[1]), bool)
    step = max(1, VECTOR // b.shape[1])
    for at in range(0, len(a), step):
        part = a[at : at + step]
        out[at : at + step] = (_bits(part, b, len(letters)) if m <= 64 else _banded(part, b, most)) <= most
    return out


def _bits(a: np.ndarray, b: np.ndarray, letters: int) -> np.ndarray:
    r, m = a.shape
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if m <= k(0).nbytes * 8)
    masks = np.zeros((r, letters), kind)
    for j in range(m):
        masks[np.arange(r), a[:, j]] |= kind(1 << j)
    one, top = kind(1), kind(m - 1)
    up, down = np.full((r, b.shape[1]), ~kind(0), kind), np.zeros((r, b.shape[1]), kind)
    score = np.full(up.shape, m, np.int16)
    for column in b:
        eq = masks.take(column, axis=1)
        across = (((eq & up) + up) ^ up) | eq
        more, less = down | ~(across | up), up & across
        score += ((more >> top) & one).astype(np.int8)
        score -= ((less >> top) & one).astype(np.int8)
        more, less = (more << one) | one, less << one
        eq |= down
        up, down = less | ~(eq | more), more & eq
    return score


def _banded(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Distances as far as they are at most ``most``, for keys of any length."""
    m, n, shape = a.shape[1], len(b), (len(a), b.shape[1])
    far = np.full(shape, most + 1, np.int16)
    last = {j: np.full(shape, j, np.int16) for j in range(min(n, most) + 1)}
    for i in range(1, m + 1):
        row = {}
        for j in range(max(0, i - most), min(n, i + most) + 1):
            if not j:
                row[0] = np.full(shape, i, np.int16)
                continue
            best = last.get(j - 1, far) + (a[:, i - 1][:, None] != b[j - 1][None, :])
            best = np.minimum(best, np.minimum(last.get(j, far), row.get(j - 1, far)) + 1)
            row[j] = best.astype(np.int16)
        last = row
    return last.get(n, far)


def by_length(keys: list[str]) -> dict[int, np.ndarray]:
    sizes = np.array([len(k) for k in keys], int)
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


def first_like(leaders: list[str], keys: list[str], symmetric: bool) -> np.ndarray:
    """For each key the place of the first of ``leaders``, all earlier than it, that it is like; their number if none."""
    out = np.full(len(keys), len(leaders), int)
    lead = {n: (at, matrix([leaders[k] for k in at], n)) for n, at in by_length(leaders).items()}
    for n, at in by_length(keys).items():
        own = [keys[k] for k in at]
        codes = matrix(own, n)
        for la, (places, mine) in lead.items():
            longer, shorter = max(la, n), min(la, n)
            if bound(longer) and longer - shorter <= (bound(longer) if symmetric else min(bound(longer), bound(n))):
                hit = near(mine, codes, bound(longer))
                out[at] = np.minimum(out[at], np.where(hit.any(0), places[hit.argmax(0)], len(leaders)))
            if shorter >= 6 and shorter < longer <= 2 * shorter:
                for place in places:
                    x = leaders[place]
                    hit = [k for k, y in zip(at, own) if out[k] > place and (x in y if la < n else y in x)]
                    out[hit] = place
    return out


def first_leaders(keys: list[str], symmetric: bool, most: int) -> tuple[list[int], np.ndarray]:
    """The first leaders of keys in their order, ``most`` at most, and for each key the place of its leader (-1: open)."""
    of, found = np.full(len(keys), -1, int), []
    groups = {n: (at, matrix([keys[k] for k in at], n)) for n, at in by_length(keys).items()}
    for k, key in enumerate(keys):
        if of[k] >= 0:
            continue
        if len(found) == most:
            break
        found.append(k)
        of[k] = k
        la, mine = len(key), matrix([key], len(key))
        for n, (at, codes) in groups.items():
            longer, shorter = max(la, n), min(la, n)
            open_ = (at > k) & (of[at] < 0)
            if bound(longer) and longer - shorter <= (bound(longer) if symmetric else min(bound(longer), bound(n))) and open_.any():
                rest = at[open_]
                of[rest[near(mine, codes[open_], bound(longer))[0]]] = k
            if shorter >= 6 and shorter < longer <= 2 * shorter:
                for j in at[(at > k) & (of[at] < 0)]:
                    if (key in keys[j]) if la < n else (keys[j] in key):
                        of[j] = k
    return found, of


def led_by(batches: Iterable[pa.RecordBatch], ids: list[int], leaders: list[str], symmetric: bool) -> Iterator[pa.RecordBatch]:
    """``id`` and ``key`` of keys with the first of ``leaders`` (``ids``, ascending) that each is or is like, if any.

    The leaders are all that the keys up to the last of them have, so keys before a leader are like an earlier one.
    """
    number = np.array([*ids, 0], np.int64)
    for batch in batches:
        own, keys = batch.column("id").to_numpy(), batch.column("key").to_pylist()
        place = first_like(leaders, keys, symmetric)
        at = np.searchsorted(number[:-1], own)
        lead = number[np.minimum(at, len(ids))] == own
        lead &= at < len(ids)
        place = np.where(lead, at, place)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(number[place], mask=place == len(ids))], ["id", "key", "leader"])


def tiles(batches: Iterable[pa.RecordBatch], symmetric: bool) -> Iterator[pa.RecordBatch]:
    """Pairs within the bound of tiles: ``block``, and its keys of one length on either side.

    A pair comes out in the smallest of the blocks that it shares, in one direction.
    """
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            block = one.column("block")[0].as_py()
            yield from _tile(block, *(pa.StructArray.from_arrays(x.flatten(), fields=list(x.type)) for x in (one.column(c).flatten() for c in ("short", "long"))), symmetric)


def _earlier(block: int, column: pa.Array) -> list[set[int]]:
    return [{x for x in y if x < block} if y else set() for y in column.to_pylist()]


def _tile(block: int, short: pa.StructArray, long: pa.StructArray, symmetric: bool) -> Iterator[pa.RecordBatch]:
    ids, ranks = ([x.field(c).to_numpy(zero_copy_only=False) for x in (short, long)] for c in ("id", "rank"))
    keys = [x.field("key").to_pylist() for x in (short, long)]
    sn, ln = len(keys[0][0]), len(keys[1][0])
    before = [_earlier(block, x.field("blocks")) for x in (short, long)]
    shared = {x: k for k, x in enumerate(set().union(*before[0]) & set().union(*before[1]))}
    marks = [np.zeros((len(x), max(1, len(shared))), np.float32) for x in before]
    for mark, sets in zip(marks, before):
        for k, own in enumerate(sets):
            mark[k, [shared[x] for x in own if x in shared]] = 1
    a, b = matrix(keys[0], sn), matrix(keys[1], ln)
    texts = pa.array(keys[0] + keys[1], pa.string())
    every = np.concatenate(ids)
    step = max(1, 16 * VECTOR // len(b))
    for at in range(0, len(a), step):
        own = slice(at, at + step)
        good = (marks[0][own] @ marks[1].T) == 0
        if sn == ln:
            x, y = ranks[0][own][:, None], ranks[1][None, :]
            good &= (x < y) | ((x == y) & (ids[0][own][:, None] < ids[1][None, :]))
        elif not symmetric and ln - sn > bound(sn):
            good &= ids[0][own][:, None] < ids[1][None, :]
        rows = np.flatnonzero(good.any(1))
        if not len(rows):
            continue
        good = good[rows] & near(a[own][rows], b, bound(ln))
        i, j = np.nonzero(good)
        i, j = rows[i] + at, j + len(a)
        swap = every[i] > every[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        for k in range(0, len(i), BATCH):
            x, y = i[k : k + BATCH], j[k : k + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(every[x]), pa.array(every[y]), texts.take(pa.array(x)), texts.take(pa.array(y))], ["a", "b", "ka", "kb"])

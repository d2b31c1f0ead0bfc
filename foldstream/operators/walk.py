"""The best items of a block of users, kept while parts of the items pass by.

Inside one task, in numpy: the users and their k best so far are held, and of the items one part at a time. Scores are
rounded to SCORE_DIGITS and ties go to the lower item id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import inf

import numpy as np
import pyarrow as pa

SCORE_DIGITS = 9
SLICE_SCORES = 1_000_000  # scores held at once
SLACK = 10.0 ** -SCORE_DIGITS  # covers rounding, and lets equal scores compete by id
#: From this share of the greatest product that a bucket allows a user, the bucket is searched by increments.
INCREMENTS_FROM = 0.4
BOX_ITEMS = 128  # items that are ruled out together
NEAR_USERS = 4096  # users that go through the boxes together
#: A greater share of boxes to score makes boxes not worth while.
BOXES_UP_TO = 0.6
_SAFE = 1e300  # scores below it are finite whatever the order of their sum
USERS = -1  # part number of the rows that are users
_BLOCK = 64
_FREE = np.iinfo(np.int64).max  # an empty place comes last, after true scores of -inf
_USERS_OUT = 4096


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    vectors = column.combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks)
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def entries(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Item ids and vectors of packed blocks."""
    ids, values = (np.concatenate([chunk.field(name).flatten().to_numpy(zero_copy_only=False) for chunk in blocks["entries"].chunks])
                   for name in ("ids", "values"))
    return ids, values.reshape(len(ids), -1)


def no_nan(scores: np.ndarray) -> None:
    """Infinite scores have a place in the order, undefined ones do not."""
    if np.isnan(scores).any():
        raise ValueError("a score is not a number")


def _places(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `np.nonzero` of a table, which goes through one axis several times faster."""
    return np.divmod(np.flatnonzero(found), found.shape[1]) if found.size else np.nonzero(found)


class Best:
    """A block of users with their `k` best items so far. Scores below a user's `floor` need not be found."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, lane: int = 0):
        self.ids, self.q, self.floor, self.k, self.lane = ids, q, floor, k, lane
        self.top = np.full((len(ids), k), -inf)
        self.top_ids = np.full((len(ids), k), _FREE)
        self.scored = np.zeros(len(ids), dtype=np.int64)
        self.lengths = np.linalg.norm(q, axis=1)
        self.near: list[np.ndarray] | None = None  # rows of users that are near each other
        self.sums: _Sums | None = None

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take in candidates: row numbers of users, item ids and scores."""
        touched = np.unique(rows)
        old, col = np.nonzero(self.top_ids[touched] != _FREE)
        old = touched[old]
        rows = np.concatenate([rows, old])
        ids = np.concatenate([ids, self.top_ids[old, col]])
        scores = np.concatenate([np.round(scores, SCORE_DIGITS) + 0.0, self.top[old, col]])
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = place < self.k
        at = rows[keep], place[keep]
        self.top[at], self.top_ids[at] = scores[keep], ids[keep]

    def bar(self, rows: np.ndarray | slice) -> np.ndarray:
        """What a score must reach to matter: the k-th best so far, or the floor."""
        return np.maximum(self.top[rows, self.k - 1], self.floor[rows])

    def score(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        """Score all of some items."""
        scores = self.q[rows] @ v.T
        no_nan(scores)
        self.scored[rows] += len(ids)
        bar, n, k = self.bar(rows), len(ids), self.k
        if n > k:
            # the k-th greatest of block maxima is at most the k-th score and cheaper to find
            blocks = n // _BLOCK
            tops = scores[:, :blocks * _BLOCK].reshape(len(rows), blocks, _BLOCK).max(axis=2) if blocks >= k else scores
            bar = np.maximum(bar, np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k])
        # keeps everything that can tie with the k-th score after rounding
        r, c = _places(scores >= np.where(np.isinf(bar), bar, bar - SLACK)[:, None])
        self.offer(rows[r], ids[c], scores[r, c])

    def found(self) -> Iterator[pa.Table]:
        for at in range(0, len(self.ids), _USERS_OUT):
            held = slice(at, at + _USERS_OUT)
            r, c = np.nonzero((self.top_ids[held] != _FREE) & (self.top[held] >= self.floor[held, None]))
            yield pa.table({"user_id": self.ids[held][r], "item_id": self.top_ids[held][r, c], "score": self.top[held][r, c],
                            "rank": (c + 1).astype(np.int32)})


def _all_pairs(best: Best, users: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
    """Score each of some users of the block with every item of a part."""
    step = max(1, SLICE_SCORES // len(ids))
    for at in range(0, len(users), step):
        best.score(users[at:at + step], ids, v)


def _boxes(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in an order in which neighbours are near each other, and where boxes of at most `most` start: they are
    halved again and again along the coordinate in which they differ most."""
    n = len(v)
    order, starts = np.arange(n), np.array([0, n])
    while (np.diff(starts) > most).any():
        middles = (starts[:-1] + starts[1:]) // 2
        for start, middle, end in zip(starts[:-1], middles, starts[1:]):
            own = order[start:end]
            rows = v[own]
            axis = np.argmax(rows.max(axis=0) - rows.min(axis=0))
            order[start:end] = own[np.argpartition(rows[:, axis], middle - start)]
        starts = np.sort(np.concatenate([starts, middles]))
    return order, starts


def all_of(best: Best, ids: np.ndarray, v: np.ndarray) -> None:
    """The result of scoring every user of the block with every item of a part.

    The items lie in boxes; no item of a box can score more than its best corner, so a user scores the boxes whose corner
    reaches the user's bar and no others. Users that are near each other go together, from their best box on. A user
    without `k` items yet takes its bar from the boxes with the best corners.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        reach = np.abs(best.q) @ np.abs(v).max(axis=0, initial=0.0)
    if len(ids) < 4 * BOX_ITEMS or len(ids) <= best.k or not (np.isfinite(v).all() and (reach < _SAFE).all()):
        # undefined and infinite scores are found by scoring
        _all_pairs(best, np.arange(len(best.ids)), ids, v)
        return
    order, starts = _boxes(v, BOX_ITEMS)
    ids, v = ids[order], v[order]
    lo, hi = (op.reduceat(v, starts[:-1], axis=0) for op in (np.minimum, np.maximum))
    corners = np.concatenate([(lo + hi) / 2, (hi - lo) / 2], axis=1)
    # what rounding may take from a corner's score or add to a bar
    slack = SLACK + 1e-12 * reach
    if best.near is None:
        by, cuts = _boxes(best.q, NEAR_USERS)
        best.near = [by[i:j] for i, j in zip(cuts[:-1], cuts[1:])]
    for users in best.near:
        step = max(1, 4 * SLICE_SCORES // len(corners))
        for at in range(0, len(users), step):
            _search_boxes(best, users[at:at + step], ids, v, starts, corners, slack)


def _search_boxes(best: Best, users: np.ndarray, ids: np.ndarray, v: np.ndarray, starts: np.ndarray, corners: np.ndarray,
                  slack: np.ndarray) -> None:
    q, slack = best.q[users], slack[users]
    tops = corners @ np.concatenate([q, np.abs(q)], axis=1).T
    bar = best.bar(users) - slack
    unknown = np.nonzero(np.isneginf(bar))[0]
    if len(unknown):
        bar[unknown] = _first_bars(best.k, q[unknown], tops[:, unknown], starts, v) - slack[unknown]
    reached = tops >= bar
    if reached.mean() > BOXES_UP_TO:
        _all_pairs(best, users, ids, v)
        return

    held, n_held = [], 0

    def take() -> None:
        nonlocal held, n_held, bar
        best.offer(*(np.concatenate(x) for x in zip(*held)))
        bar = np.maximum(bar, best.bar(users) - slack)
        held, n_held = [], 0

    boxes = np.nonzero(reached.any(axis=1))[0]
    for b in boxes[np.argsort(-reached[boxes].sum(axis=1), kind="stable")]:
        active = np.nonzero(tops[b] >= bar)[0]
        if not len(active):
            continue
        box = slice(starts[b], starts[b + 1])
        scores = q[active] @ v[box].T
        best.scored[users[active]] += scores.shape[1]
        r, c = _places(scores >= bar[active, None])
        if len(r):
            held.append((users[active[r]], ids[box][c], scores[r, c]))
            n_held += len(r)
        if n_held > len(users) * best.k:
            take()
    if held:
        take()


def _first_bars(k: int, q: np.ndarray, tops: np.ndarray, starts: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Per user the k-th best score among the items of the boxes with the best corners: the k-th best of all is no less."""
    size = int(np.diff(starts).min())
    n = min(len(tops), -(-2 * k // size))
    if n * size < k:
        return np.full(len(q), -inf)
    best_boxes = np.argpartition(tops, len(tops) - n, axis=0)[len(tops) - n:].T
    bars = np.empty(len(q))
    step = max(1, SLICE_SCORES // (n * size * v.shape[1]))
    for at in range(0, len(q), step):
        items = (starts[best_boxes[at:at + step]][:, :, None] + np.arange(size)).reshape(-1, n * size)
        scores = (v[items] @ q[at:at + step, :, None])[:, :, 0]
        bars[at:at + step] = np.partition(scores, n * size - k, axis=1)[:, n * size - k]
    return bars


def by_length(bucket_size: int, focus: int) -> Callable[[Best, np.ndarray, np.ndarray], None]:
    """Score only what can matter, with the result of `all_of`.

    A part is cut into buckets of items by falling length; a bucket whose longest item cannot reach a user's bar ends the
    part for that user. In a bucket that comes close to its bound only (from INCREMENTS_FROM on), the products over the `focus`
    greatest coordinates of the user and the lengths of what is left bound each item's score, and the items that cannot
    reach the bar are not scored. With `focus` 0, or vectors too short for it to pay, lengths alone decide.
    """

    def search(best: Best, ids: np.ndarray, v: np.ndarray) -> None:
        lengths = np.linalg.norm(v, axis=1)
        order = np.argsort(-lengths, kind="stable")
        ids, v, lengths = ids[order], v[order], lengths[order]
        increments = 0 < 2 * focus <= v.shape[1]
        width = max(1, SLICE_SCORES // (best.k + bucket_size))
        for at in range(0, len(best.ids), width):
            active = np.arange(at, min(at + width, len(best.ids)))
            if increments:
                of, q, rest = _focused(best, active, focus)
            for b in range(0, len(ids), bucket_size):
                # later buckets are shorter and bars only rise: who is out stays out
                bar = best.bar(active)
                with np.errstate(invalid="ignore"):
                    reach = best.lengths[active] * lengths[b]
                # 0 * inf says nothing about the bucket: it is scored
                stays = np.isnan(reach) | (reach * (1 + 1e-12) + SLACK >= bar)
                active, bar, reach = active[stays], bar[stays], reach[stays]
                if not len(active):
                    break
                some = slice(b, b + bucket_size)
                near = np.isfinite(reach) & (bar >= INCREMENTS_FROM * reach) if increments else np.zeros(len(active), bool)
                if not near.all():
                    best.score(active[~near], ids[some], v[some])
                if near.any():
                    own = active[near] - at
                    r, c = _candidates(of[own], q[own], rest[own], v[some], lengths[some], bar[near])
                    rows = active[near][r]
                    scores = _pair_scores(best.q, rows, v[some], c)
                    no_nan(scores)
                    np.add.at(best.scored, rows, 1)
                    good = np.round(scores, SCORE_DIGITS) >= best.bar(rows)
                    best.offer(rows[good], ids[some][c[good]], scores[good])

    return search


def _pair_scores(q: np.ndarray, r: np.ndarray, v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products of pairs of rows; of the vectors that pairs repeat, SLICE_SCORES components are held at once."""
    scores, step = np.empty(len(r)), max(1, SLICE_SCORES // q.shape[1])
    for at in range(0, len(r), step):
        some = slice(at, at + step)
        scores[some] = np.einsum("ij,ij->i", q[r[some]], v[c[some]])
    return scores


def _rest(whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Length of what is left of vectors, a little too great so that rounding cannot make it too small."""
    return np.sqrt(np.maximum(whole ** 2 - part, 0.0) + 1e-12 * whole ** 2)


def _focused(best: Best, rows: np.ndarray, focus: int) -> tuple[np.ndarray, ...]:
    """Per user: its greatest coordinates, their values, and the length of the others."""
    q = best.q[rows]
    of = np.argpartition(-np.abs(q), focus - 1, axis=1)[:, :focus]
    values = np.take_along_axis(q, of, axis=1)
    with np.errstate(invalid="ignore"):
        return of, values, _rest(best.lengths[rows], (values ** 2).sum(axis=1))


def _candidates(of: np.ndarray, q: np.ndarray, rest: np.ndarray, v: np.ndarray, lengths: np.ndarray,
                bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a user and an item of a bucket that may reach the user's bar."""
    by_coordinate = np.ascontiguousarray(v.T)
    partial, squares = np.zeros((len(of), len(v))), np.zeros((len(of), len(v)))
    for j in range(of.shape[1]):
        x = by_coordinate[of[:, j]]
        partial += q[:, j, None] * x
        squares += x * x
    with np.errstate(invalid="ignore"):
        bound = partial + rest[:, None] * _rest(lengths[None, :], squares)
        # what is not a number says nothing
        return np.nonzero(~(bound + SLACK < bar[:, None]))


def walk(k: int, search: Callable[[Best, np.ndarray, np.ndarray], None],
         out: Callable[[Best], Iterator[pa.Table]] = Best.found) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For `mapInArrow` over rows (chunk, lane, part, user_id, vec, floor, entries) sorted by chunk, lane and part.

    A cell is a chunk of users and a lane of parts; its users come first. Held at once: its users, their `k` best, and
    one part of the items.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, best, part = None, None, USERS
        held: list[pa.Table] = []

        def take() -> None:
            nonlocal best, held
            if not held:
                return
            rows, held = pa.concat_tables(held), []
            if part == USERS:
                best = Best(rows["user_id"].to_numpy(), matrix(rows["vec"]), rows["floor"].to_numpy(), k, cell[1])
            elif best is not None:
                search(best, *entries(rows))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            keys = np.stack([rows[c].to_numpy() for c in ("chunk", "lane", "part")], axis=1)
            starts = np.concatenate([[0], np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1, [len(keys)]])
            for start, end in zip(starts[:-1], starts[1:]):
                chunk, lane, at = keys[start]
                if (chunk, lane) != cell or at != part:
                    take()
                if (chunk, lane) != cell:
                    if best is not None:
                        for done in out(best):
                            yield from done.to_batches()
                    cell, best = (chunk, lane), None
                part = at
                held.append(rows.slice(start, end - start))
        take()
        if best is not None:
            for done in out(best):
                yield from done.to_batches()

    return run


class _Sums:
    """Number, sum, least and greatest of the scores of a block of users."""

    def __init__(self, n_users: int):
        self.n, self.total = 0, np.zeros(n_users)
        self.lo, self.hi = np.full(n_users, np.nan), np.full(n_users, -inf)


def sum_up(best: Best, ids: np.ndarray, v: np.ndarray) -> None:
    """Score every user of the block with every item of a part, and keep what `summaries` gives."""
    if best.sums is None:
        best.sums = _Sums(len(best.ids))
    sums, step = best.sums, max(1, SLICE_SCORES // len(ids))
    sums.n += len(ids)
    for at in range(0, len(best.ids), step):
        some = slice(at, at + step)
        scores = best.q[some] @ v.T
        sums.total[some] += scores.sum(axis=1)
        # as Spark orders them: what is not a number comes last
        sums.lo[some] = np.fmin(sums.lo[some], scores.min(axis=1))
        sums.hi[some] = np.maximum(sums.hi[some], scores.max(axis=1))


def summaries(best: Best) -> Iterator[pa.Table]:
    """Per user: number of scores, their sum, least and greatest; nothing where there were no items."""
    if best.sums is not None:
        s = best.sums
        yield pa.table({"user_id": best.ids, "n": np.full(len(best.ids), s.n, dtype=np.int64), "total": s.total, "lo": s.lo, "hi": s.hi})


def scored_pairs(best: Best) -> Iterator[pa.Table]:
    """Per user: the number of items that were scored."""
    yield pa.table({"user_id": best.ids, "scored": best.scored})


def found_in_lane(best: Best) -> Iterator[pa.Table]:
    """What was found, with the number of the lane."""
    for found in best.found():
        yield found.append_column("lane", pa.array(np.full(found.num_rows, best.lane, dtype=np.int32)))

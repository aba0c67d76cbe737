"""Exact Euclidean distances to the nearest target pixel, by tiles.

1. Each (band of rows, column) gives its first and last target row: one small row. Running passes over the bands of a column
   add the nearest target above and below the band.
2. Each tile then knows the vertical gap to the nearest target at each of its places, so the distances within its own columns.
   Of the other tiles of the band, each needs those columns only whose parabola is lowest somewhere in it: only columns
   with a smaller gap than all columns nearer to it can be, and the lower envelope of these says where. A row of pixels
   sends at most the tile's side plus a few places a tile.
3. Each tile takes the lower of its own distances and the envelope of the columns it was sent.

No task sees a whole column or row of the grid, and the work is linear in both. Columns count where they have targets
anywhere, whether or not they have pixels in the band.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 512
FAR = np.iinfo(np.int64).max // 4  # a squared gap beyond all others


def band_ends(px: DataFrame, is_target: Column, tile: int) -> DataFrame:
    """``(_tr, _tc, _c, above, below, _left, _right)``: for each column with a target and each band of rows, the nearest
    target row before and after the band, and the first and last tile of the grid's bands."""
    band, side = F.floor(F.col("row") / tile), F.floor(F.col("col") / tile)
    target = F.when(F.coalesce(is_target, F.lit(False)), F.col("row"))
    ends = px.groupBy(band.alias("_tr"), "col").agg(F.min(target).alias("first"), F.max(target).alias("last"))
    span = px.agg(F.min(band).alias("_low"), F.max(band).alias("_high"), F.min(side).alias("_left"), F.max(side).alias("_right"))  # one row
    found = ends.filter("first IS NOT NULL")
    every = found.select("col").distinct().join(F.broadcast(span)).select("col", "_left", "_right", F.explode(F.sequence("_low", "_high")).alias("_tr"))
    t = every.join(found, ["_tr", "col"], "left")
    earlier = Window.partitionBy("col").orderBy("_tr").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("col").orderBy(F.desc("_tr")).rowsBetween(Window.unboundedPreceding, -1)
    outer = [F.max("last").over(earlier).alias("above"), F.min("first").over(later).alias("below")]
    return t.select("_tr", side.alias("_tc"), F.col("col").alias("_c"), *outer, "_left", "_right")


def vertical_gaps(rows: np.ndarray, cols: np.ndarray, above: np.ndarray, below: np.ndarray, tile: int) -> np.ndarray:
    """Squared gaps of all places of a tile, from its targets (places within it) and the nearest ones outside (NaN: none)."""
    at = np.arange(tile, dtype=float)[:, None]
    seen = np.full((tile, tile), np.nan)
    seen[rows, cols] = rows
    up = np.fmax.accumulate(np.vstack([above[None, :], seen]), axis=0)[1:]
    down = np.fmin.accumulate(np.vstack([seen, below[None, :]])[::-1], axis=0)[::-1][:-1]
    gap = np.fmin(at - up, down - at)
    return np.where(np.isnan(gap), FAR, np.nan_to_num(gap) ** 2).astype(np.int64)


def within(gaps: np.ndarray) -> np.ndarray:
    """Squared distances through the tile's own columns: shifts of the gaps, until a shift alone is longer than any distance."""
    out = gaps.copy()
    for d in range(1, gaps.shape[1]):
        if d * d >= out.max():
            break
        np.minimum(out[:, d:], gaps[:, :-d] + d * d, out=out[:, d:])
        np.minimum(out[:, :-d], gaps[:, d:] + d * d, out=out[:, :-d])
    return out


def envelope(x: list[int], h: list[int]) -> tuple[list[int], list[float]]:
    """Lower envelope of the parabolas (at - x)² + h for ascending ``x``: places in ``x``, and where each becomes lowest."""
    hull: list[int] = []
    starts: list[float] = []
    for q in range(len(x)):
        start = -np.inf
        while hull:
            p = hull[-1]
            start = (h[q] + x[q] * x[q] - h[p] - x[p] * x[p]) / (2 * (x[q] - x[p]))
            if start > starts[-1]:
                break
            hull.pop(), starts.pop()
            start = -np.inf
        hull.append(q), starts.append(start)
    return hull, starts


def reaching(gaps: np.ndarray, first_col: int, own: int, low: int, high: int, tile: int) -> dict[int, list[tuple[int, int, int]]]:
    """For each other tile of the band (``low`` to ``high``) the places (row, column, squared gap) that may be lowest in it."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    tail = np.full((len(gaps), 1), FAR, np.int64)
    after = np.minimum.accumulate(np.hstack([gaps[:, 1:], tail])[:, ::-1], axis=1)[:, ::-1]
    before = np.minimum.accumulate(np.hstack([tail, gaps[:, :-1]]), axis=1)
    for kept, others in ((gaps < after, np.arange(own + 1, high + 1)), (gaps < before, np.arange(low, own))):
        if not len(others):
            continue
        for r in np.flatnonzero(kept.any(axis=1)):
            cols = np.flatnonzero(kept[r])
            x, h = (cols + first_col).tolist(), gaps[r, cols].tolist()
            hull, starts = envelope(x, h)
            starts_ = np.array(starts)
            a = np.searchsorted(starts_, others * tile, side="right") - 1
            b = np.searchsorted(starts_, others * tile + tile - 1, side="right")
            for t, i, j in zip(others.tolist(), np.maximum(a, 0).tolist(), b.tolist(), strict=True):
                out.setdefault(t, []).extend((int(r), x[q], h[q]) for q in hull[i:j])
    return out


PLACES = "_tr long, _tc long, _own boolean, _rows array<int>, _cols array<int>, _sq array<long>"


def _places(tr: int, made: list[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
    lists = [pa.array([m[i] for m in made], k) for i, k in zip((2, 3, 4), kinds, strict=True)]
    return pa.table([pa.array([tr] * len(made), pa.int64()), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.bool_()), *lists], ["_tr", "_tc", "_own", "_rows", "_cols", "_sq"])


def distance_to(px: DataFrame, is_target: Column, res: float, at: Column | None = None, tile: int = TILE) -> DataFrame:
    """``(row, col, dist)``: the distance of the pixels (those ``at``, if given) to the nearest target; NULL without any."""
    ends = band_ends(px, is_target, tile)
    tiles = [F.floor(F.col("row") / tile).alias("_tr"), F.floor(F.col("col") / tile).alias("_tc")]
    valued = F.lit(True) if at is None else F.coalesce(at, F.lit(False))
    marked = px.select(*tiles, "row", "col", F.coalesce(is_target, F.lit(False)).alias("_t"), valued.alias("_v"))

    def own(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        tr, tc = (k.as_py() for k in key)
        top, side = tr * tile, tc * tile
        row, col = left.column("row").to_numpy() - top, left.column("col").to_numpy() - side
        hit, want = (left.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("_t", "_v"))
        outer = []
        for name in ("above", "below"):
            line = np.full(tile, np.nan)
            line[right.column("_c").to_numpy() - side] = right.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False) - top
            outer.append(line)
        gaps = vertical_gaps(row[hit], col[hit], *outer, tile)
        made = [(tc, True, left.column("row").to_numpy()[want], left.column("col").to_numpy()[want], within(gaps)[row[want], col[want]])]
        if right.num_rows:
            low, high = (right.column(c)[0].as_py() for c in ("_left", "_right"))
            for t, places in reaching(gaps, side, tc, low, high, tile).items():
                r, c, sq = (np.array(v) for v in zip(*places, strict=True))
                made.append((t, False, r + top, c, sq))
        return _places(tr, made)

    def lowest(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        mine = t.column("_own").to_numpy(zero_copy_only=False).astype(bool)
        flat = lambda c, which: t.column(c).filter(pa.array(which)).combine_chunks().flatten().to_numpy()
        row, col, sq = (flat(c, mine) for c in ("_rows", "_cols", "_sq"))
        r, c, h = (flat(x, ~mine) for x in ("_rows", "_cols", "_sq"))
        best = sq.copy()
        order, theirs = np.lexsort((col, row)), np.lexsort((c, r))
        r, c, h = r[theirs], c[theirs], h[theirs]
        row_, col_ = row[order], col[order]
        lines, starts = np.unique(row_, return_index=True)
        stops = np.append(starts[1:], len(row_))[: len(lines)]
        for line, i, j, a, b in zip(lines, starts, stops, np.searchsorted(r, lines), np.searchsorted(r, lines, side="right"), strict=True):
            if a < b:
                x, own_h = c[a:b], h[a:b]
                hull, begin = envelope(x.tolist(), own_h.tolist())
                q = np.array(hull)[np.searchsorted(np.array(begin), col_[i:j], side="right") - 1]
                best[order[i:j]] = np.minimum(best[order[i:j]], (col_[i:j] - x[q]) ** 2 + own_h[q])
        known = best < FAR
        return pa.table([pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(np.sqrt(np.where(known, best, 0)) * res, pa.float64(), mask=~known)], ["row", "col", "dist"])

    keys = ("_tr", "_tc")
    placed = marked.groupBy(*keys).cogroup(ends.groupBy(*keys)).applyInArrow(own, PLACES)
    return placed.groupBy(*keys).applyInArrow(lowest, "row int, col int, dist double")

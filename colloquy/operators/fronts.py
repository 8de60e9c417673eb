"""Fronts of any number of objectives (all minimised): reduced where the rows are, carried over generations, and their hypervolume.

Fronts merge associatively: a row that some row of its group beats can go before any shuffle, so batches are reduced where they are
read (``reduced``) and only rows of small fronts move. Equal rows stay; rows with a null or NaN objective are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

#: Rows that are compared in one matrix.
BLOCK = 256
#: Groups of at most so many rows are compared pair by pair, those of a batch at once.
SMALL = 64


def beaten(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which points some row of ``others`` beats."""
    out = np.zeros(len(points), bool)
    for at in range(0, len(others), BLOCK):
        left = np.flatnonzero(~out)
        o, p = others[at : at + BLOCK, None], points[left]
        for cut in range(0, len(p), BLOCK):
            some = p[cut : cut + BLOCK]
            out[left[cut : cut + BLOCK]] = ((o <= some).all(2) & (o < some).any(2)).any(0)
    return out


def first_front(points: np.ndarray) -> np.ndarray:
    """Mask of the points that none beats. Equal points are compared once, and in order of their coordinates only earlier ones beat a point."""
    order = np.lexsort(points.T[::-1])
    new = changes(points[order])
    some = points[order[new]]
    stay = np.zeros(len(some), bool)
    if some.shape[1] <= 2:
        stay[:1] = True
        if some.shape[1] == 2:
            stay[1:] = some[1:, 1] < np.minimum.accumulate(some[:, 1])[:-1]
    else:
        kept = some[:0]
        for at in range(0, len(some), BLOCK):
            block = np.arange(at, min(at + BLOCK, len(some)))
            for others in (kept, some[block]):
                block = block[~beaten(some[block], others)]
            stay[block] = True
            kept = np.concatenate([kept, some[block]])
    mask = np.zeros(len(points), bool)
    mask[order] = stay[np.cumsum(new) - 1]
    return mask


def changes(rows: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before them."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    return new


def pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of each run (first and size given), those of one first row together."""
    rows = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    many = np.repeat(sizes, sizes)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(rows, many), np.repeat(np.repeat(starts, sizes), many) + at


def beats(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the points a beat those of b, place by place."""
    all_, some = np.ones(len(a), bool), np.zeros(len(a), bool)
    for column in points.T:
        x, y = column[a], column[b]
        all_ &= x <= y
        some |= x < y
    return all_ & some


def first_fronts(points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Mask of the points that none of their group beats; groups lie between ``cuts``. Small ones are compared all at once."""
    group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    # the point of the least sum beats most
    best = np.lexsort((points.sum(1), group))[cuts[:-1]]
    left = np.flatnonzero(~beats(points, best[group], np.arange(len(points))))
    sizes = np.bincount(group[left], minlength=len(cuts) - 1)
    starts, small = np.cumsum(sizes) - sizes, sizes <= SMALL
    mask = np.zeros(len(points), bool)
    mask[left] = True
    row, other = pairs(starts[small], sizes[small])
    mask[left[row[beats(points[left], other, row)]]] = False
    for a, n in zip(starts[~small], sizes[~small], strict=True):
        rows = left[a : a + n]
        mask[rows] = first_front(points[rows])
    return mask


def points_of(table: pa.Table | pa.RecordBatch, objectives: list[str]) -> np.ndarray:
    return np.stack([table.column(o).to_numpy(zero_copy_only=False).astype(float) for o in objectives], 1)


def runs(table: pa.Table, by: list[str]) -> np.ndarray:
    """Where runs of rows with equal ``by`` start, and the number of rows."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in by:
        codes = table.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def known(rows: DataFrame, objectives: list[str]) -> DataFrame:
    for o in objectives:
        rows = rows.filter(F.col(o).isNotNull() & ~F.isnan(F.col(o).cast("double")))
    return rows


def reduced(rows: DataFrame, by: list[str], objectives: list[str]) -> DataFrame:
    """``rows`` without those that a row of their group in the same batch beats: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            codes = np.zeros(table.num_rows, np.int64)
            for c in by:
                part = table.column(c).combine_chunks().dictionary_encode("encode")
                codes = np.unique(codes * (len(part.dictionary) + 1) + part.indices.to_numpy(), return_inverse=True)[1]
            points, order = points_of(table, objectives), np.argsort(codes, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(codes[order], prepend=-1)), len(order))
            if len(order):
                yield batch.take(pa.array(np.sort(order[first_fronts(points[order], cuts)])))

    return known(rows, objectives).mapInArrow(run, rows.schema)


def front(rows: DataFrame, by: list[str], objectives: list[str]) -> DataFrame:
    """Rows that no row of their group beats; without ``by`` there is one group, whose rows are reduced in two rounds before they meet."""
    if not by:
        tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
        first = reduced(rows, [], objectives)
        # neighbours by the first objective beat each other most
        met = reduced(first.repartitionByRange(max(1, int(tasks**0.5)), objectives[0]), [], objectives)
        return fold_fronts(met.coalesce(1), [], objectives)
    return fold_fronts(reduced(rows, by, objectives).repartition(*by).sortWithinPartitions(*by), by, objectives)


def fold_fronts(rows: DataFrame, by: list[str], objectives: list[str]) -> DataFrame:
    """Fronts of rows that come group by group; of the last group the front so far is held, and compared anew once as many rows have come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for table in gathered(batches, lambda: held):
            cuts, points = runs(table, by), points_of(table, objectives)
            stay, last = first_fronts(points, cuts), cuts[-2]
            held = table.slice(last).filter(pa.array(stay[last:])).combine_chunks()
            yield from table.slice(0, last).filter(pa.array(stay[:last])).combine_chunks().to_batches()
        if held is not None:
            yield from held.to_batches()

    return rows.mapInArrow(run, rows.schema)


def gathered(batches: Iterator[pa.RecordBatch], held: Callable[[], pa.Table | None]) -> Iterator[pa.Table]:
    """What is held, with as many rows behind it at least as it has, so that holding rows takes no more work than reading them."""
    fresh, n = [], 0
    for batch in batches:
        fresh.append(batch)
        n += batch.num_rows
        before = held()
        if n and (before is None or n >= before.num_rows):
            table = pa.Table.from_batches(fresh)
            fresh, n = [], 0
            yield (table if before is None else pa.concat_tables([before, table])).combine_chunks()
    if n:
        yield pa.concat_tables([held(), pa.Table.from_batches(fresh)]).combine_chunks()


def whole_groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, of rows that come group by group, and where in them groups start and end."""
    held = None
    for table in gathered(batches, lambda: held):
        cuts = runs(table, [by])
        held = table.slice(cuts[-2]).combine_chunks()
        if len(cuts) > 2:
            yield table.slice(0, cuts[-2]), cuts[:-1]
    if held is not None:
        yield held, np.array([0, held.num_rows])


def cumulative_fronts(rows: DataFrame, by: str, generation: str, objectives: list[str]) -> DataFrame:
    """Rows that are ever on the front of all rows of their group up to a generation, with ``left``: the first generation that beats them (null: none).

    The front after generation g is made of the rows of a generation <= g whose ``left`` is null or > g, so all prefixes are in
    one table as large as the rows that enter. The rows of a generation are reduced where they are read; then groups of few rows
    are settled many at once, and of larger ones generations come in order and only the front so far is held.
    """
    schema = StructType([*rows.schema.fields, StructField("left", rows.schema[generation].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = front = None

        def with_left(table: pa.Table, at: pa.Array) -> list[pa.RecordBatch]:
            return table.append_column("left", at).combine_chunks().to_batches()

        def ended(table: pa.Table) -> list[pa.RecordBatch]:
            return with_left(table, pa.nulls(table.num_rows, table.schema.field(generation).type))

        def advanced(group: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Carries the front over a group's generations, which lie between ``ends``."""
            nonlocal front
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                fresh = group.slice(a, b - a)
                new = points_of(fresh, objectives)
                stay = first_front(new)
                if front is not None:
                    old = points_of(front, objectives)
                    stay &= ~beaten(new, np.unique(old, axis=0))
                    lost = beaten(old, np.unique(new[stay], axis=0))
                    if lost.any():
                        gone = front.filter(pa.array(lost))
                        at = fresh.column(generation)[0].as_py()
                        yield from with_left(gone, pa.array([at] * gone.num_rows, gone.schema.field(generation).type))
                    front = front.filter(pa.array(~lost))
                fresh = fresh.filter(pa.array(stay))
                front = (fresh if front is None else pa.concat_tables([front, fresh])).combine_chunks()

        def settled(table: pa.Table, cuts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            """What whole groups (between ``cuts``) give, the first of which may have a front so far."""
            nonlocal front
            sizes = np.diff(cuts)
            small = sizes <= BLOCK
            small[:1] &= front is None
            for k in np.flatnonzero(~small):
                yield from advanced(table.slice(cuts[k], sizes[k]), ends[np.searchsorted(ends, cuts[k]) : np.searchsorted(ends, cuts[k + 1]) + 1] - cuts[k])
                yield from ended(front)
                front = None
            # the first generation of the rows that beat a row; to all but its own and earlier ones the row is on the front
            points, places = points_of(table, objectives), np.searchsorted(ends, np.arange(table.num_rows), "right") - 1
            none = len(ends)
            few = np.flatnonzero(small)
            # so many groups at once that there are some 500,000 pairs
            for part in np.split(few, np.searchsorted(np.cumsum(sizes[few] ** 2), np.arange(500_000, (sizes[few] ** 2).sum(), 500_000))):
                if not len(part):
                    continue
                row, other = pairs(cuts[part], sizes[part])
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                cut = np.minimum.reduceat(np.where(beats(points, other, row), places[other], none), first)
                enter = cut > places[row[first]]
                at = pa.array(np.where(cut == none, 0, ends[np.minimum(cut, none - 1)])[enter], mask=(cut == none)[enter])
                yield from with_left(table.take(pa.array(row[first][enter])), table.column(generation).take(at))

        for table in gathered(batches, lambda: held):
            # rows that their own generation beats never enter
            table = table.filter(pa.array(first_fronts(points_of(table, objectives), runs(table, [by, generation])))).combine_chunks()
            cuts, ends = runs(table, [by]), runs(table, [by, generation])
            last = cuts[-2]
            if last:
                yield from settled(table.slice(0, last), cuts[:-1], ends[: np.searchsorted(ends, last) + 1])
            held = table.slice(last)
            if front is not None or held.num_rows > BLOCK:
                # the last generation may go on
                own = ends[np.searchsorted(ends, last) :] - last
                yield from advanced(held, own[:-1])
                held = held.slice(own[-2])
            held = held.combine_chunks()
        if held is not None:
            yield from settled(held, np.array([0, held.num_rows]), runs(held, [by, generation]))

    ordered = reduced(rows, [by, generation], objectives).repartition(by).sortWithinPartitions(by, generation)
    return ordered.mapInArrow(run, schema)


def front_sizes(members: DataFrame, by: str, generation: str) -> DataFrame:
    """For each generation at which a group's cumulative front changes: rows that enter, rows that leave, and its size."""
    enter = members.groupBy(by, generation).agg(F.count("*").alias("entered"))
    leave = members.filter("left is not null").groupBy(by, F.col("left").alias(generation)).agg(F.count("*").alias("gone"))
    both = enter.join(leave, [by, generation], "full").fillna(0, ["entered", "gone"])
    return both.withColumn("size", F.sum(F.col("entered") - F.col("gone")).over(Window.partitionBy(by).orderBy(generation)))


def volume(points: np.ndarray, ref: np.ndarray) -> float:
    """Volume that the points beat up to the reference point, by slices along the last objective."""
    points = points[(points < ref).all(1)]
    if not len(points):
        return 0.0
    if points.shape[1] == 1:
        return float(ref[0] - points.min())
    if points.shape[1] == 2:
        order = np.lexsort((points[:, 1], points[:, 0]))
        x, y = points[order, 0], np.minimum.accumulate(points[order, 1])
        return float(((np.append(x[1:], ref[0]) - x) * (ref[1] - y)).sum())
    points = points[np.argsort(points[:, -1], kind="stable")]
    if points.shape[1] == 3:
        # for each slice the area that the points up to it beat: by x, the least y so far
        depth, order = np.diff(points[:, 2], append=ref[2]), np.argsort(points[:, 0], kind="stable")
        width, y = np.diff(points[order, 0], append=ref[0]), points[order, 1]
        total = 0.0
        for at in range(0, len(points), BLOCK):
            slices = np.arange(at, min(at + BLOCK, len(points)))
            least = np.minimum.accumulate(np.where(order <= slices[:, None], y, ref[1]), 1)
            total += float(depth[slices] @ ((ref[1] - least) @ width))
        return total
    total, base = 0.0, points[:0, :-1]
    for i, p in enumerate(points):
        base = np.concatenate((base, points[i : i + 1, :-1]))
        base = base[first_front(base)]
        depth = (points[i + 1, -1] if i + 1 < len(points) else ref[-1]) - p[-1]
        if depth > 0:
            total += depth * volume(base, ref[:-1])
    return total


def normalised_hypervolume(rows: DataFrame, by: str, objectives: list[str], ref: float = 1.01) -> DataFrame:
    """by, n (rows of the front) and the volume that a group's front beats up to ``ref`` in each objective, scaled by the front's least and largest values.

    An objective in which all of a front are equal counts as 0. A group's front is held in one task; its work grows with a power of the number of objectives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, by):
            points = points_of(table, objectives)
            low, high = np.minimum.reduceat(points, cuts[:-1]), np.maximum.reduceat(points, cuts[:-1])
            group = np.repeat(np.arange(len(low)), np.diff(cuts))
            points = (points - low[group]) / np.where(high > low, high - low, 1.0)[group]
            # equal points count once
            order = np.lexsort((*points.T[::-1], group))
            keep = order[changes(np.column_stack((group, points))[order])]
            points, ends = points[keep], np.searchsorted(group[keep], np.arange(len(cuts)))
            sizes = [volume(points[a:b], np.full(len(objectives), ref)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([column(table, by, cuts), pa.array(np.diff(cuts), pa.int64()), pa.array(sizes, pa.float64())], [by, "n", "hypervolume"])

    # a group's front comes from one task, group by group
    return front(rows, [by], objectives).mapInArrow(run, StructType([rows.schema[by], *StructType.fromDDL("n long, hypervolume double").fields]))


def column(table: pa.Table, by: str, cuts: np.ndarray) -> pa.Array:
    """The groups' names."""
    return table.column(by).take(pa.array(cuts[:-1])).combine_chunks()


def plus_distances(rows: DataFrame, by: str, objectives: list[str], reference: DataFrame, most: int = 100_000) -> DataFrame:
    """by, gd_plus and igd_plus of each group's front against a reference front, scaled by its least and largest values.

    A point counts only by how much it is worse than a reference point. The reference goes to the tasks; one of over ``most`` rows is an error.
    """
    points = [[r[o] for o in objectives] for r in known(reference, objectives).select(*objectives).distinct().limit(most + 1).collect()]
    if not points or len(points) > most:
        raise ValueError(f"a reference front has 1 to {most} different points")
    z = np.array(points, float)
    z = z[first_front(z)]
    low, high = z.min(0), z.max(0)
    size = np.where(high > low, high - low, 1.0)
    z = (z - low) / size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, by):
            points, group = points_of(table, objectives), np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            # equal points count once
            order = np.lexsort((*points.T[::-1], group))
            keep = order[changes(np.column_stack((group, points))[order])]
            a, starts = (points[keep] - low) / size, np.searchsorted(group[keep], np.arange(len(cuts) - 1))
            nearest, back = np.full(len(a), np.inf), np.zeros(len(starts))
            step = max(1, 500_000 // len(a))
            for at in range(0, len(z), step):
                d = np.sqrt(sum(np.maximum(x[:, None] - y, 0) ** 2 for x, y in zip(a.T, z[at : at + step].T, strict=True)))
                nearest = np.minimum(nearest, d.min(1))
                back += np.minimum.reduceat(d, starts).sum(1)
            gd = np.add.reduceat(nearest, starts) / np.diff(starts, append=len(a))
            yield pa.RecordBatch.from_arrays([column(table, by, cuts), pa.array(gd), pa.array(back / len(z))], [by, "gd_plus", "igd_plus"])

    return front(rows, [by], objectives).mapInArrow(run, StructType([rows.schema[by], *StructType.fromDDL("gd_plus double, igd_plus double").fields]))

"""Resampling: interpolation onto given instants, and centred window averages."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.neighbours import NEXT, PREV, around, col
from ..schema import KEY, TS, channels

LINEAR, NEAREST, NEAREST_UP, PREVIOUS, FOLLOWING, SPLINES = ("linear", "slinear"), ("nearest",), ("nearest-up",), ("previous", "zero"), ("next",), ("quadratic", "cubic")


def uniform_grid(df: DataFrame, rate_hz: float, key: str = KEY, ts: str = TS) -> DataFrame:
    """(recording, instant): from the first sample, by the truncated step, before the last sample."""
    step = int(1e9 / rate_hz)
    span = df.groupBy(col(key)).agg(F.min(col(ts)).alias("__a"), F.max(col(ts)).alias("__b")).where("__b > __a")
    return span.select(col(key), F.explode(F.sequence("__a", F.col("__b") - 1, F.lit(step))).alias(ts))


def _pick(kind: str, t: Column, i: int, is_float: bool) -> Column:
    t0, t1, y0, y1 = F.col(f"{PREV}.t"), F.col(f"{NEXT}.t"), F.col(f"{PREV}.c{i}"), F.col(f"{NEXT}.c{i}")
    if kind in LINEAR:
        # Differences of integers first: doubles cannot hold today's nanoseconds exactly.
        return F.when(t0 == t1, y0.cast("double")).otherwise(y0 + (y1 - y0) * ((t - t0) / (t1 - t0)))
    if kind in NEAREST:
        return F.when((t - t0) <= (t1 - t), y0).otherwise(y1)
    if kind in NEAREST_UP:
        return F.when((t - t0) < (t1 - t), y0).otherwise(y1)
    if kind in PREVIOUS:
        return y0
    if kind in FOLLOWING:
        return y1
    raise ValueError(f"unknown kind of interpolation: {kind}")


def interpolate(source: DataFrame, targets: DataFrame, columns: list[str] | None = None, float_kind: str = "linear", other_kind: str = "nearest", max_gap_ms: float | None = 500, key: str = KEY, ts: str = TS, chunk_ns: int | None = None) -> DataFrame:
    """Values of ``source`` at the instants of ``targets`` (whose other columns stay).

    Instants beyond the source's range give null.  With ``max_gap_ms`` both
    neighbours must be strictly closer than it, unless the instant is a sample's own.
    Doubles follow ``float_kind``, other types ``other_kind``; a null neighbour makes a
    linear value null.  Integers keep their type.  Quadratic and cubic kinds are
    splines through all samples of a recording (see ``splines``).
    """
    columns = columns or channels(source, key, ts)
    kinds = dict(source.dtypes)
    is_float = {c: kinds[c] in ("double", "float") for c in columns}
    out = around(source, targets, columns, key, ts, chunk_ns)
    t, t0, t1 = col(ts), F.col(f"{PREV}.t"), F.col(f"{NEXT}.t")
    ok = t0.isNotNull() & t1.isNotNull()
    if max_gap_ms is not None:
        limit = int(max_gap_ms * 1e6)
        ok = ok & ((t0 == t1) | (((t - t0) < limit) & ((t1 - t) < limit)))
    values = {}
    for i, c in enumerate(columns):
        kind = float_kind if is_float[c] else other_kind
        if kind not in SPLINES:
            values[c] = F.when(ok, _pick(kind, t, i, is_float[c]))
    curved = [c for c in columns if c not in values]
    keep = [c for c in targets.columns if c not in (key, ts, *columns)]
    out = out.select(col(key), col(ts), *[col(c) for c in keep], *[v.alias(c) for c, v in values.items()], ok.alias("__ok"))
    if curved:
        out = splines(source, out, curved, 2 if float_kind == "quadratic" else 3, key, ts)
    return out.select(col(key), col(ts), *[col(c) for c in keep], *[(F.when(F.col("__ok"), col(c)).alias(c) if c in curved else col(c)) for c in columns])


#: Rows of the recordings whose splines are solved at once, and samples of a recording that is solved alone.
STACK, LONG = 65_536, 20_000


def _basis(knots: np.ndarray, span: np.ndarray, t: np.ndarray, degree: int) -> np.ndarray:
    """The ``degree + 1`` B-splines that are not zero between the knots at ``span`` and after it."""
    b = np.ones((len(t), 1))
    for d in range(1, degree + 1):
        new = np.zeros((len(t), d + 1))
        for r in range(d):
            right, left = knots[span + r + 1], knots[span + r + 1 - d]
            part = b[:, r] / np.where(right > left, right - left, 1)
            new[:, r] += (right - t) * part
            new[:, r + 1] += (t - left) * part
        b = new
    return b


def _eliminate(band: np.ndarray, c: np.ndarray, degree: int) -> None:
    """Solve one banded system in place, of bandwidth ``degree`` on either side, without filling the matrix."""
    n = len(c) - degree
    for i in range(n):
        for j in range(i + 1, min(n, i + degree + 1)):
            f = band[j, i - j + degree] / band[i, degree]
            if f:
                width = min(degree + 1, n - i)
                band[j, i - j + degree : i - j + degree + width] -= f * band[i, degree : degree + width]
                c[j] -= f * c[i]
    for i in range(n - 1, -1, -1):
        c[i] = (c[i] - band[i, degree + 1 :] @ c[i + 1 : i + 1 + degree]) / band[i, degree]


def _eliminate_all(band: np.ndarray, c: np.ndarray, starts: np.ndarray, counts: np.ndarray, degree: int) -> None:
    """The same for many systems that lie one after another, ``degree`` empty rows behind each: a step of all of them at once."""
    order = np.argsort(-counts, kind="stable")
    starts, most = starts[order], int(counts.max(initial=0))
    active = np.searchsorted(np.sort(counts), np.arange(most + degree + 1), side="right")
    active = len(counts) - active  # systems of more than i rows come first
    for i in range(most):
        for j in range(1, degree + 1):
            a = starts[: active[i + j]] + i
            f = band[a + j, degree - j] / band[a, degree]
            band[a + j, degree - j : 2 * degree - j + 1] -= f[:, None] * band[a, degree:]
            c[a + j] -= f * c[a]
    for i in range(most - 1, -1, -1):
        a = starts[: active[i]] + i
        rest = sum(band[a, degree + k] * c[a + k] for k in range(1, degree + 1))
        c[a] = (c[a] - rest) / band[a, degree]


def spline_values(xs: list[np.ndarray], ys: list[np.ndarray], ats: list[np.ndarray], degree: int) -> list[np.ndarray]:
    """Interpolating B-splines with not-a-knot ends, one for each place of the lists; any NaN makes a result NaN."""
    out = [np.full(len(at), np.nan) for at in ats]
    usable = [k for k, (x, y) in enumerate(zip(xs, ys)) if len(x) > degree and np.isfinite(y).all()]
    together = [k for k in usable if len(xs[k]) <= LONG]
    for own in [*([together] if together else []), *[[k] for k in usable if len(xs[k]) > LONG]]:
        knots, spans, asked = [], [], []
        for k in own:
            x = xs[k]
            inner = x[2:-2] if degree == 3 else (x[1:-2] + x[2:-1]) / 2
            knots.append(np.concatenate([np.full(degree + 1, x[0]), inner, np.full(degree + 1, x[-1])]))
            for found, t in ((spans, x), (asked, ats[k])):
                found.append(np.clip(np.searchsorted(knots[-1], t, side="right") - 1, degree, len(knots[-1]) - degree - 2))
        counts, points, width = (np.array([len(v) for v in lists]) for lists in ([xs[k] for k in own], asked, knots))
        starts, first = np.cumsum(counts + degree) - counts - degree, np.cumsum(width) - width
        every, span, place = np.concatenate(knots), np.concatenate(spans), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        b = _basis(every, span + np.repeat(first, counts), np.concatenate([xs[k] for k in own]), degree)
        band, c = np.zeros((int((counts + degree).sum()), 2 * degree + 1)), np.zeros(int((counts + degree).sum()))
        at = np.repeat(starts, counts) + place
        for k in range(degree + 1):
            offset = span + k - place
            ok = (offset >= 0) & (offset <= 2 * degree)
            band[at[ok], offset[ok]] = b[ok, k]
        c[at] = np.concatenate([ys[k] for k in own])
        if len(own) > 1:
            _eliminate_all(band, c, starts, counts, degree)
        else:
            _eliminate(band, c, degree)
        span = np.concatenate(asked)
        b = _basis(every, span + np.repeat(first, points), np.concatenate([ats[k] for k in own]), degree)
        values = (c[(span - degree + np.repeat(starts, points))[:, None] + np.arange(degree + 1)] * b).sum(1)
        for k, v in zip(own, np.split(values, np.cumsum(points)[:-1])):
            out[k] = v
    return out


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray, degree: int) -> np.ndarray:
    """The interpolating B-spline with not-a-knot ends; any NaN makes the result NaN."""
    return spline_values([x], [y.astype(float)], [at], degree)[0]


def splines(source: DataFrame, targets: DataFrame, columns: list[str], degree: int, key: str = KEY, ts: str = TS) -> DataFrame:
    """``targets`` with spline values.

    A spline depends on all samples of its recording, so a recording stays in one task;
    a task goes through its recordings in order and solves short ones together.
    """
    given, names = list(targets.columns), [f"__s{i}" for i in range(len(columns))]
    left = source.where(col(ts).isNotNull()).select(col(key), col(ts).cast(targets.schema[ts].dataType).alias(ts), *[col(c).cast("double").alias(n) for c, n in zip(columns, names)], F.lit(False).alias("__asked"))
    both = left.unionByName(targets.withColumn("__asked", F.lit(True)), allowMissingColumns=True)
    rows = both.repartition(col(key)).sortWithinPartitions(col(key), "__asked", col(ts), *[F.asc_nulls_last(n) for n in names])
    schema = T.StructType([*targets.schema.fields, *[T.StructField(c, T.DoubleType()) for c in columns]])

    def begins(table: pa.Table) -> np.ndarray:
        """Where recordings begin."""
        codes = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
        return np.flatnonzero(np.diff(codes, prepend=-1))

    def solved(table: pa.Table) -> list[pa.RecordBatch]:
        asked = table.column("__asked").to_numpy()
        times = table.column(ts).fill_null(0).to_numpy()
        data = [table.column(n).cast(pa.float64()).to_numpy() for n in names]
        found = [np.full(len(asked), np.nan) for _ in names]
        xs, ats, picks, places = [], [], [], []
        first = begins(table)
        for a, b in zip(first, [*first[1:], len(asked)]):
            m = a + int(np.searchsorted(asked[a:b], True))
            if m == a or m == b:
                continue
            once = a + np.flatnonzero(np.diff(times[a:m], prepend=times[a] - 1))  # the first of samples at one instant
            x = (times[once] - times[a]) / 1e9
            xs.append(x)
            ats.append(np.clip((times[m:b] - times[a]) / 1e9, x[0], x[-1]))
            picks.append(once)
            places.append(slice(m, b))
        for y, values in zip(data, found):
            for place, v in zip(places, spline_values(xs, [y[p] for p in picks], ats, degree)):
                values[place] = v
        rest = table.select(given).filter(pa.array(asked))
        for c, values in zip(columns, found):
            rest = rest.append_column(c, pa.array(values[asked], from_pandas=True))
        return rest.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, least = [], 0, STACK
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= least:
                table = pa.Table.from_batches(held)
                last = int(begins(table)[-1])
                if last:
                    yield from solved(table.slice(0, last))
                held = table.slice(last).to_batches()
                count -= last
                least = max(STACK, 2 * count)  # a long recording is not looked through with every batch
        if count:
            yield from solved(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)


def window_average(source: DataFrame, targets: DataFrame, window_ns: int, columns: list[str] | None = None, key: str = KEY, ts: str = TS) -> DataFrame:
    """Mean of the samples in (t - w/2, t + w/2] at every target instant.

    Nulls are left out, an empty window gives null; integers are rounded half to even
    and keep their type.  One shuffle: targets join the samples as rows without values.
    """
    columns = columns or channels(source, key, ts)
    kinds = dict(source.dtypes)
    bad = [c for c in columns if kinds[c] in ("string", "boolean", "binary")]
    if bad:
        raise TypeError(f"cannot average columns of other than numbers: {bad}")
    names = {c: f"__v{i}" for i, c in enumerate(columns)}
    keep = [c for c in targets.columns if c not in (key, ts)]
    left = source.select(col(key), col(ts), *[col(c).alias(n) for c, n in names.items()], F.lit(False).alias("__asked"))
    right = targets.select(col(key), col(ts), *[col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.lit(True).alias("__asked"))
    w = Window.partitionBy(col(key)).orderBy(col(ts)).rangeBetween(-(math.ceil(window_ns / 2) - 1), window_ns // 2)
    out = left.unionByName(right, allowMissingColumns=True)
    for c, n in names.items():
        mean = F.avg(n).over(w)
        out = out.withColumn(f"__m{n}", mean if kinds[c] in ("double", "float") else F.rint(mean).cast(kinds[c]))
    return out.where("__asked").select(col(key), col(ts), *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"__m{n}").alias(c) for c, n in names.items()])

"""Embedding whitening by a two-pass covariance.

Every entry c becomes the integer floor(1024 c) + 100000, so sums are exact. The first pass adds up integer sums and row numbers,
the second the outer products of the rows centred by the exact mean, one NumPy matrix product a batch. Both merge per-partition partials
(one small array a partition, never rows) by treeAggregate. LAPACK's symmetric eigensolver runs on the driver over one
dims x dims matrix (``most_dims`` at most), and the projection, dims x components numbers, is broadcast. A third pass measures the
covariance of the whitened values themselves. Nothing is shuffled but partials; a lost executor costs its partitions of one pass.

Defined results: a row is dropped where its vector is null, empty, or holds a null or non-finite entry or one whose integer exceeds
2^43 in size; of vectors of unlike lengths those of the most frequent one remain (of equally frequent ones the longest); repeated
rows and null keys stay; an empty table, or one without a remaining row, gives an empty result. A component whose eigenvalue is not
above rounding error (constant or repeated dimensions, fewer rows than components) has null whitened values and is left out of the
identity error, which is null if no component is left; explained is null where the trace is 0. A deviation above the largest LONG is null.
Of two of a name the result counts: kept columns are ``keep``, others are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, released

SCALE, SHIFT, MOST_INTEGER, BATCH = 1024, 100_000, 1 << 43, 4096
RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def integers(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, integer rows) of the valid vectors of an array, one for each length."""
    filled = pc.fill_null(vectors, pa.scalar([], vectors.type))
    offsets = filled.offsets.to_numpy().astype(np.int64)
    flat = pc.cast(filled.values, pa.float64())
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for d in np.unique(sizes[sizes > 0]).tolist():
        places = np.flatnonzero(sizes == d)
        rows = values[offsets[places][:, None] + np.arange(d)]
        with np.errstate(invalid="ignore", over="ignore"):
            scaled = np.floor(SCALE * rows)
            fine = (np.abs(scaled) <= MOST_INTEGER - SHIFT).all(axis=1)
        if fine.any():
            yield d, places[fine], scaled[fine].astype(np.int64) + SHIFT


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as LONGs where they fit, else as Python integers."""
    if n * (int(np.abs(x).max()) + 1) + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squared(difference: np.ndarray) -> pa.Array:
    """Sums of squares, exact; null above the largest LONG."""
    if difference.dtype != object and int(np.abs(difference).max()) ** 2 * difference.shape[1] < 1 << 63:
        return pa.array((difference * difference).sum(axis=1))
    sums = (difference.astype(object) ** 2).sum(axis=1)
    return pa.array([int(x) if x < 1 << 63 else None for x in sums], pa.int64())


def _gathered(rows: DataFrame, partial) -> dict:
    """{length: (rows, array)} that ``partial`` makes of every partition, added up in a tree of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = partial(batch.column(0).slice(at, BATCH) for batch in batches for at in range(0, batch.num_rows, BATCH))
        released()
        for d, (n, values) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([n], pa.int64()), pa.array([_stored(values)], pa.binary())], names=["d", "n", "data"])

    def add(total: dict, row) -> dict:
        return merge(total, {row["d"]: (row["n"], _restored(row["data"]))})

    def merge(left: dict, right: dict) -> dict:
        for d, (n, values) in right.items():
            known = left.get(d)
            left[d] = (n, values) if known is None else (known[0] + n, known[1] + values)
        return left

    return rows.mapInArrow(run, "d long, n long, data binary").rdd.treeAggregate({}, add, merge, depth=2)


def _stored(values: np.ndarray) -> bytes:
    """Matrices as doubles; integer sums, of any size, as text."""
    return b"d" + values.tobytes() if values.dtype == np.float64 else b"i" + " ".join(map(str, values.tolist())).encode()


def _restored(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], np.float64) if data[:1] == b"d" else np.array([int(x) for x in data[1:].split()], object)


def integer_sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """First pass: {length: (n, sums of each dimension)}, exact."""

    def partial(arrays) -> dict:
        found: dict = {}
        for vectors in arrays:
            for d, _, x in integers(vectors):
                n, sums = found.get(d, (0, np.zeros(d, object)))
                found[d] = n + len(x), sums + x.sum(axis=0).astype(object)  # BATCH rows of 2^43 fit a LONG
        return found

    return {d: (n, [int(s) for s in sums]) for d, (n, sums) in _gathered(rows, partial).items()}


def outer_products(rows: DataFrame, d: int, n: int, sums: list[int], onto: np.ndarray | None = None) -> np.ndarray:
    """Second pass: the covariance of the centred rows, of their projections where ``onto`` is given."""

    def partial(arrays) -> dict:
        total = None
        for vectors in arrays:
            for size, _, x in integers(vectors):
                if size == d:
                    centred = (deviations(x, n, sums) / n).astype(np.float64)
                    centred = centred if onto is None else centred @ onto
                    product = centred.T @ centred
                    total = product if total is None else total + product
        return {} if total is None else {d: (0, total.ravel())}

    side = d if onto is None else onto.shape[1]
    return _gathered(rows, partial)[d][1].reshape(side, side) / n


def components_of(covariance: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; the entry of largest size is positive."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:number], vectors[:, ::-1][:, :number]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1, signs)


def whitened(table: DataFrame, components: int = 8, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), most_dims: int = 4096) -> DataFrame:
    """One row for each remaining vector and component, numbered from 1 by falling eigenvalue.

    ``keep`` columns, ``component``, ``n``, ``deviation`` (sum of (n x - S)^2), ``whitened``, ``explained``, ``identity_error``.
    """
    spark = table.sparkSession
    keep = tuple(c for c in keep if c.lower() not in RESULTS)
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in table.select(*map(column, keep)).schema)
    schema = f"{kinds + ', ' if kinds else ''}component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = table.select(column(vector).cast("array<double>").alias("_vector")).where("_vector IS NOT NULL")
    known = integer_sums(vectors)
    if not known:
        return spark.createDataFrame([], schema)
    d = max(known, key=lambda size: (known[size][0], size))
    n, sums = known[d]
    if d > most_dims:
        raise ValueError(f"vectors have {d} dimensions, more than {most_dims}")
    covariance = outer_products(vectors, d, n, sums)
    values, directions = components_of(covariance, components)
    trace = float(np.trace(covariance))
    live = values > trace * d * np.finfo(float).eps if trace > 0 else np.zeros(len(values), bool)
    onto = directions[:, live] / np.sqrt(values[live])
    error = float(np.abs(outer_products(vectors, d, n, sums, onto) - np.eye(live.sum())).max()) if live.any() else None
    shares = [float(v) / trace if trace > 0 else None for v in values]
    projection = spark.sparkContext.broadcast(onto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, places_live = len(shares), np.flatnonzero(live)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                for size, places, x in integers(batch.column(batch.num_columns - 1)):
                    if size != d:
                        continue
                    difference = deviations(x, n, sums)
                    made = np.full((len(x), number), np.nan)
                    made[:, places_live] = (difference / n).astype(np.float64) @ projection.value
                    again = pa.array(np.repeat(places, number))
                    own = pa.array(np.repeat(np.arange(len(x)), number))
                    total = len(x) * number
                    flat = pa.array(made.ravel(), mask=np.isnan(made.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i).take(again) for i in range(len(keep))), pa.array(np.tile(np.arange(1, number + 1, dtype=np.int32), len(x))), pa.array(np.full(total, n)),
                         squared(difference).take(own), flat, pa.array(shares * len(x), pa.float64()), pa.array([error] * total, pa.float64())],
                        names=[*keep, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return table.select(*map(column, keep), column(vector).cast("array<double>").alias("_vector")).mapInArrow(run, schema)


def op12_whitening(spark, sf_dir):
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))

"""Embedding whitening by polarisation (operator 13).

A component c becomes the whole number x = floor(64 * c) + 1000000.  The fit list
holds each distinct x vector once; n are its vectors, S their sums by dimension.

Covariance.  For two dimensions, var(i + j) = var(i) + var(j) + 2 cov(i, j), so the
variances of all dimensions and of all sums of two dimensions give every
covariance.  Values are centred first, at the whole number next below their mean,
z = x - floor(S / n); tasks add up the squares z_i^2 and (z_i + z_j)^2 exactly, as
whole numbers, batch by batch, and a grouped sum joins the tasks' totals.  With
s = S - n * floor(S / n), what the whole centre leaves out is taken off exactly:
n^2 var(i) = n * sum(z_i^2) - s_i^2, and so for the sums of two.  The differences of
these whole numbers are rounded once, on division.  The driver sees d * (d + 1) / 2
numbers for d dimensions, whatever the rows, and calls eigh.

Edge cases: a vector that is null or holds a null or non-finite entry is dropped;
vectors shorter than the longest are filled up with zeros; repeated rows, and
rows with null ids, are all in the result while equal vectors count once in the
fit; equal eigenvalues keep the order that eigh gives; components without variance
(under `LEAST` of the trace) are left out, so one distinct vector, or an empty
table, gives an empty result; extra columns are ignored.  An entry of 2^40 or more
raises an error, as x would lose its last digits.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import bounded_batches
from vellum.llm.topk import whole
from vellum.session import cut_lineage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LIMIT = 1 << 40     # largest entry
SMALL = 1 << 20     # centred values under it have squares that int64 adds up over a batch
LEAST = 1e-12       # least share of the trace of a component that is returned
EXACT = pa.decimal128(38, 0)


def fixed_point(df: DataFrame, vector: str = "embedding", out: str = "x") -> DataFrame:
    """Rows whose vector is whole, with ``out``: floor(64 * c) + 1000000 of each
    entry, as many as the longest vector has."""
    entry = F.col(f"`{vector}`")
    # an entry that is too large fails the query, where floor would give its limit
    number = lambda c: F.when(F.abs(c) < LIMIT, F.floor(SCALE * c.cast("double")) + SHIFT).otherwise(
        F.raise_error(F.lit("an embedding's entry exceeds 2^40")).cast("long"))
    rows = df.filter(whole(entry)).withColumn(out, F.transform(entry, number))
    least, most = df.filter(whole(entry)).agg(F.min(F.size(entry)), F.max(F.size(entry))).first()
    if least != most:
        rows = rows.withColumn(out, F.concat(out, F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(most) - F.size(out))))
    return rows


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a table of whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_sum(a: np.ndarray) -> np.ndarray:
    """Column sums as Python's whole numbers."""
    return a.sum(axis=0).astype(object)


def totals(fit: DataFrame, kernel, names: list[str]) -> list:
    """Grouped exact sums of what ``kernel`` yields for each batch of vectors: a list
    of index arrays and an array of whole numbers, whose sums a task adds up."""
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in names] + [T.StructField("total", T.DecimalType(38, 0))])

    def run(batches):
        held = None
        for b in batches:
            if b.num_rows:
                index, part = kernel(matrix(b.column(0)))
                held = part if held is None else held + part
        if held is not None:
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(i, pa.int32()) for i in index), pa.array(map(Decimal, held), EXACT)], names=schema.names)

    return bounded_batches(fit.select("x")).mapInArrow(run, schema).groupBy(*names).agg(F.sum("total").alias("total")).collect()


def sums(fit: DataFrame) -> list[int]:
    """Sum of each dimension."""
    found = totals(fit, lambda x: ([np.arange(x.shape[1])], exact_sum(x)), ["i"])
    return [int(r["total"]) for r in sorted(found)]


def squares(fit: DataFrame, centre: list[int]) -> dict[tuple[int, int], int]:
    """Sums of z_i^2, under (i, i), and of (z_i + z_j)^2, under (i, j)."""
    m = np.array(centre, np.int64)

    def kernel(x: np.ndarray):
        z = x - m
        if np.abs(z).max() >= SMALL:
            z = z.astype(object)
        d, parts = z.shape[1], []
        for i in range(d):
            both = z[:, i:i + 1] + z[:, i:]
            both[:, 0] = z[:, i]
            parts.append(exact_sum(both * both))
        return list(np.triu_indices(d)), np.concatenate(parts)

    return {(r["i"], r["j"]): int(r["total"]) for r in totals(fit, kernel, ["i", "j"])}


def covariance(n: int, rest: list[int], square: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariances from the variances of dimensions and of sums of two; ``rest``
    are the sums of the centred values."""
    d = len(rest)
    v = np.zeros((d, d))
    alone = [n * square[i, i] - rest[i] ** 2 for i in range(d)]
    for (i, j), total in square.items():
        two = n * total - (rest[i] + rest[j]) ** 2
        v[i, j] = v[j, i] = alone[i] / n ** 2 if i == j else (two - alone[i] - alone[j]) / (2 * n ** 2)
    return v


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> dict:
    """Whitening of the distinct vectors ``x`` of ``fit``: n, whole centre, rest, and
    for each component its direction, eigenvalue and share of the trace."""
    n = fit.count()
    total = sums(fit) if n else []
    centre = [t // n for t in total]
    rest = [t - n * c for t, c in zip(total, centre, strict=True)]
    v = covariance(n, rest, squares(fit, centre)) if total else np.zeros((0, 0))
    values, vectors = np.linalg.eigh(v) if total else (np.zeros(0), v)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(v))
    order = [i for i in order if values[i] > LEAST * trace]
    vectors = vectors[:, order]
    if order:  # the largest entry of a direction is positive
        top = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]
        vectors = vectors * np.where(top < 0, -1.0, 1.0)
    return {"n": n, "centre": np.array(centre, np.int64), "rest": rest, "vectors": vectors,
            "values": values[order], "explained": values[order] / trace if order else np.zeros(0)}


def project(x: np.ndarray, model: dict) -> np.ndarray:
    """Whitened components of rows."""
    z = (x - model["centre"]).astype(np.float64) - np.array([r / model["n"] for r in model["rest"]])
    return z @ (model["vectors"] / np.sqrt(model["values"]))


def deviations(x: np.ndarray, model: dict) -> list[int]:
    """Sum over dimensions of (n * x - S)^2, exact: n^2 sum(z^2) - 2 n sum(z s) + sum(s^2)."""
    n, rest = model["n"], model["rest"]
    z = x - model["centre"]
    large = max(int(np.abs(z).max(initial=0)), 1)
    if large >= SMALL or large * n * len(rest) >= 1 << 62:
        z = z.astype(object)
    square, mixed = (z * z).sum(axis=1), z @ np.array(rest, z.dtype)
    last = sum(r * r for r in rest)
    return [n * n * a - 2 * n * b + last for a, b in zip(square.tolist(), mixed.tolist(), strict=True)]


def identity_error(fit: DataFrame, model: dict) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus identity."""
    k = len(model["values"])

    def run(batches):
        held = np.zeros((k + 1, k))
        for b in batches:
            if b.num_rows:
                w = project(matrix(b.column(0)), model)
                held += np.vstack((w.T @ w, w.sum(axis=0)))
        i, j = np.indices(held.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(held.ravel())],
                                         names=["i", "j", "total"])

    if not k:
        return 0.0
    found = bounded_batches(fit.select("x")).mapInArrow(run, "i int, j int, total double")
    held = np.zeros((k + 1, k))
    for r in found.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        held[r["i"], r["j"]] = r["total"] / model["n"]
    return float(np.abs(held[:k] - np.outer(held[k], held[k]) - np.eye(k)).max())


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each
    row with a whole vector and each component; ``deviation`` is a decimal, as n^3
    soon exceeds a long."""
    rows = fixed_point(df.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{vector}`").alias("vector")), "vector")
    fit = cut_lineage(rows.select("x").distinct())
    model = fit_whitening(fit, components)
    error = identity_error(fit, model)
    k = len(model["values"])
    schema = T.StructType([T.StructField(vec_id, df.schema[vec_id].dataType), *T._parse_datatype_string(
        "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double").fields])
    names = schema.names

    def run(batches):
        for b in batches:
            if not (b.num_rows and k):
                continue
            x = matrix(b.column(1))
            again = np.repeat(np.arange(len(x)), k)
            size = len(again)
            far = pa.array(map(Decimal, deviations(x, model)), EXACT)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                 pa.array(np.full(size, model["n"]), pa.int64()), far.take(pa.array(again)),
                 pa.array(project(x, model).ravel()), pa.array(np.tile(model["explained"], len(x))),
                 pa.array(np.full(size, error))], names=names)

    return bounded_batches(rows.select("id", "x")).mapInArrow(run, schema)

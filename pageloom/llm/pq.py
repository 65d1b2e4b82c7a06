"""Embedding near-duplicates: product quantisation with inverted lists and an exact rerank.

Vectors link if their labels are equal and not null, their lengths are equal and their cosine, in double
precision, is ``threshold`` or more. Vectors that are null, empty, zero or hold null or non-finite components link with nothing.

1. Equal vectors of one label become one class with a count (told apart by 128 bits of hash).
2. On a hash sample of at most about ``fit_rows`` classes, fixed by parameter, the driver fits coarse centroids and a codebook for each subspace
   of the residuals.
3. Every class goes to the list of its nearest centroid, with the codes of its residual and the length e of what the codes leave.
   It visits each other list that can hold a neighbour: a unit vector x of list a has none within distance r in list i
   if (|x-ci|^2 - |x-cj|^2) / (2 |ci-cj|) > r for some j. So the probes are sufficient, not a fixed number.
4. Within a list, distances from the query to the codes are sums of table look-ups (asymmetric distances); as the true distance differs from them by e at
   most, those over r + e are passed over and the rest get the exact cosine. No pair is lost to the quantiser.
5. Lists of over ``block_rows`` rows are cut into blocks, and each pair of blocks is a unit of work. A unit returns a
   count and one edge for each row that links, never its pairs.

Results for repeated rows: each row is a vector of its own. Null vec_id: the row takes part and names no
component unless alone; then component_id is null and kept false. Extra columns are ignored, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, stash

_SLACK = 1e-6


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows."""
    x = np.asarray(x, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _squares(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


@dataclass
class Quantiser:
    coarse: np.ndarray  # lists x dim
    books: np.ndarray  # subspaces x codes x dim / subspaces
    radius: float

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Own list, codes, what the codes leave, and squared distances to all centroids."""
        d2 = _squares(x, self.coarse)
        own = d2.argmin(1)
        rest = x - self.coarse[own]
        m, _, w = self.books.shape
        codes = np.empty((len(x), m), np.int16)
        made = np.empty_like(rest)
        for i in range(m):
            codes[:, i] = _squares(rest[:, i * w : (i + 1) * w], self.books[i]).argmin(1)
            made[:, i * w : (i + 1) * w] = self.books[i][codes[:, i]]
        return own, codes, np.sqrt(((rest - made) ** 2).sum(1)), d2

    def probes(self, own: np.ndarray, d2: np.ndarray, nearest: int = 4) -> np.ndarray:
        """Which lists above its own each row must visit; a pair is met in the higher of its lists."""
        gaps = np.sqrt(_squares(self.coarse, self.coarse))
        need = np.arange(len(self.coarse))[None, :] > own[:, None]
        order = np.argsort(d2, axis=1)[:, :nearest]
        for j in order.T:
            gap = gaps[j]
            far = d2 - np.take_along_axis(d2, j[:, None], 1) > 2 * (self.radius + _SLACK) * gap
            need &= ~(far & (gap > 1e-9))
        return need

    def asymmetric(self, q: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Distances from each q to each coded row of a list, by look-ups."""
        m, _, w = self.books.shape
        rest = q - self.coarse[home]
        total = np.zeros((len(q), len(codes)))
        for i in range(m):
            total += _squares(rest[:, i * w : (i + 1) * w], self.books[i])[:, codes[:, i]]
        return np.sqrt(total)


def fit(x: np.ndarray, threshold: float, lists: int, subspaces: int = 8, codes: int = 64, seed: int = 3) -> Quantiser:
    rng = np.random.default_rng(seed)
    coarse = kmeans(x, lists, 8, rng)
    rest = x - coarse[_squares(x, coarse).argmin(1)]
    w = x.shape[1] // subspaces
    books = [kmeans(rest[:, i * w : (i + 1) * w], codes, 6, rng) for i in range(subspaces)]
    return Quantiser(coarse, np.stack(books), math.sqrt(max(0.0, 2 - 2 * threshold)))


def _joined(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """lab, with the sets of i and j made one for each pair."""
    while True:
        a, b = lab[i], lab[j]
        odd = a != b
        if not odd.any():
            return lab
        low = np.minimum(a, b)[odd]
        np.minimum.at(lab, a[odd], low)
        np.minimum.at(lab, b[odd], low)
        while (lab[lab] != lab).any():
            lab = lab[lab]


def link_unit(q: Quantiser, home: int, x: np.ndarray, codes: np.ndarray, left: np.ndarray, member: np.ndarray, weight: np.ndarray, blk: np.ndarray, threshold: float, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links of a unit's rows (weights summed) and their sets; of two blocks only pairs across them."""
    n = len(x)
    links, lab = np.zeros(n, np.int64), np.arange(n)
    two = blk.min() != blk.max() if n else False
    to = np.flatnonzero(member)
    for s in range(0, n, step):
        a = np.arange(s, min(n, s + step))
        for t in range(0, len(to), step):
            b = to[t : t + step]
            near = q.asymmetric(x[a], home, codes[b]) <= q.radius + left[b][None, :] + _SLACK
            near &= (a[:, None] < b[None, :]) | ~member[a][:, None]  # a pair of members once, from its first row
            if two:
                near &= blk[a][:, None] != blk[b][None, :]
            i, j = np.nonzero(near)
            for c in range(0, len(i), 1 << 16):
                p, r = a[i[c : c + (1 << 16)]], b[j[c : c + (1 << 16)]]
                ok = np.einsum("ij,ij->i", x[p], x[r]) >= threshold
                p, r = p[ok], r[ok]
                links += np.bincount(p, weight[r], n).astype(np.int64) + np.bincount(r, weight[p], n).astype(np.int64)
                lab = _joined(lab, p, r)
    return links, lab


def _good() -> Column:
    """Whether a row's vector can link."""
    odd = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd & F.exists("embedding", lambda v: v != 0), F.lit(False))


def _keys() -> list[Column]:
    """128 bits that stand for label and vector; null where the vector links with nothing (a hash of an array passes over its nulls)."""
    plain = F.transform("embedding", lambda v: F.when(v == 0, F.lit(0).cast("double")).otherwise(v.cast("double")))
    label = F.col("label").cast("string")
    return [F.when(_good(), F.xxhash64(label, plain)).alias("k1"), F.when(_good(), F.xxhash64(F.lit(1), label, plain)).alias("k2")]


def _classes(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """(rid, k1, k2, label, dim, x, first_id, copies) of the vectors that can link."""
    keyed = vectors.where(_good()).select("vec_id", *_keys(), F.col("label").cast("string").alias("label"), F.col("embedding").alias("x"))
    grouped = keyed.groupBy("k1", "k2", "label", "x").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return stash(spark, grouped.select(F.monotonically_increasing_id().alias("rid"), "k1", "k2", "label", F.size("x").alias("dim"), "x", "first_id", "copies"), "classes")


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = 0.98, fit_rows: int = 16384, lists: int | None = None, block_rows: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors(vec_id, label, embedding). ``lists`` None: a quarter of the square root of the distinct vectors."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    classes = _classes(spark, vectors)
    n, dims = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    if n:
        named = _linked(spark, classes, n, dims, threshold, fit_rows, lists or max(4, round(math.sqrt(n) / 4)), block_rows)
    else:
        named = classes.select("k1", "k2", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component"))
    rows = vectors.select("vec_id", *_keys()).join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _column(values: np.ndarray) -> pa.Array:
    """A row of values as one binary value each."""
    data = np.ascontiguousarray(values)
    ends = np.arange(len(data) + 1, dtype=np.int64) * (data.nbytes // max(1, len(data)))
    return pa.Array.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())


def _values(column: pa.Array | pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    """The rows that _column made."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _linked(spark: SparkSession, classes: DataFrame, n: int, dims: int, threshold: float, fit_rows: int, lists: int, block_rows: int) -> DataFrame:
    """(k1, k2, n_links, component) of each class. Unit vectors and codes travel as bytes, by Arrow batches."""
    width = -(-dims // 8) * 8  # zeros at the end change no cosine

    def matrix(xs: pa.Array | pa.ChunkedArray) -> np.ndarray:
        out = np.zeros((len(xs), width))
        parts = xs.chunks if isinstance(xs, pa.ChunkedArray) else [xs]
        at = 0
        for part in parts:
            flat, size = part.flatten().to_numpy(zero_copy_only=False), np.diff(part.offsets.to_numpy())
            if len(size) and size.min() == size.max():
                out[at : at + len(size), : size[0]] = flat.reshape(len(size), size[0])
            else:
                ends = np.cumsum(size)
                for i, (s, e) in enumerate(zip(ends - size, ends)):
                    out[at + i, : e - s] = flat[s:e]
            at += len(size)
        return unit_rows(out)

    share = int((1 << 62) * min(1.0, fit_rows / n))
    sample = classes.where(F.pmod(F.xxhash64(F.lit(5), "k1", "k2"), F.lit(1 << 62)) < share).select("k1", "x").toArrow().sort_by("k1")
    if not len(sample):
        sample = classes.orderBy("k1").limit(1).select("k1", "x").toArrow()
    shared = spark.sparkContext.broadcast(fit(matrix(sample["x"]), threshold, lists))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for whole in batches:
            for s in range(0, whole.num_rows, 2048):
                b = whole.slice(s, 2048)
                x = matrix(b.column("x"))
                own, codes, left, d2 = q.encode(x)
                i, home = np.nonzero(q.probes(own, d2))
                rows = np.r_[np.arange(len(x)), i]
                member = np.r_[np.ones(len(x), bool), np.zeros(len(i), bool)]
                taken = b.select(["rid", "label", "dim", "copies"]).take(pa.array(rows))
                more = [_column(x[rows]), pa.array(np.r_[own, home].astype(np.int32)), pa.array(member), _column(codes[rows]), pa.array(left[rows])]
                yield pa.RecordBatch.from_arrays([*taken.columns, *more], ["rid", "label", "dim", "copies", "x", "home", "member", "codes", "left_over"])

    rows = classes.select("rid", "label", "dim", "x", "copies")
    placed = stash(spark, rows.mapInArrow(assign, "rid long, label string, dim int, copies long, x binary, home int, member boolean, codes binary, left_over double"), "placed")
    key = ["label", "dim", "home"]
    big = stash(spark, placed.groupBy(*key).count().where(F.col("count") > block_rows).select(*key, F.ceil(F.col("count") / block_rows).cast("int").alias("nb")), "big")
    nb = F.coalesce("nb", F.lit(1))
    dealt = placed.join(big, key, "left").withColumn("nb", nb).withColumn("blk", F.pmod(F.xxhash64(F.lit(7), "rid"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumns({"lo": F.least("blk", "other"), "hi": F.greatest("blk", "other")}).drop("other", "nb")

    def unit(t: pa.Table) -> pa.Table:
        member = t["member"].to_numpy()
        rid, home = t["rid"].to_numpy(), t["home"][0].as_py()
        hit, links, lab = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(rid) > 1 and member.any():
            codes = _values(t["codes"], np.int16, 8)
            links, lab = link_unit(shared.value, home, _values(t["x"], np.float64, width), codes, t["left_over"].to_numpy(), member, t["copies"].to_numpy(), t["blk"].to_numpy(), threshold)
            hit = np.flatnonzero(links)
        return pa.table({"rid": rid[hit], "links": links[hit], "root": rid[lab[hit]]})

    found = stash(spark, dealt.groupBy(*key, "lo", "hi").applyInArrow(unit, "rid long, links long, root long"), "found")
    roots = components(spark, found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    named = classes.select("rid", "k1", "k2", "first_id", "copies").join(counts, "rid", "left").join(roots.withColumnRenamed("v", "rid"), "rid", "left")
    named = stash(spark, named.select("k1", "k2", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rid").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("first_id").alias("component"))
    return stash(spark, named.join(least, "root").select("k1", "k2", "n_links", "component"), "components")

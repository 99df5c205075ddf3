"""Operator 13, vector code compression: product quantisation in whole numbers.

Components become floor(256 x). A vector is cut into PARTS parts, and each part is named by the nearest of the ENTRIES
entries of its codebook. A codebook starts as that part of the vectors with the smallest ids; a round assigns all parts
and replaces each entry by the floored mean of its parts.

Nearest entries are found in two steps. A float32 matrix product gives every squared distance (less the part's own
square) with an interval that holds the true value: a product of w terms is off by at most (w + 4) units of rounding
times the product of the two norms, whatever the order of the sums, and what follows is done in float64. Entries whose
interval reaches under the least upper end are evaluated again in int64, and of equal ones the least index is taken. Parts
or entries too large for int64 squares are evaluated in Python's integers.

A round is one map with sums for each task, added by Spark: 64 entries of each part are all that reaches the driver,
whatever the number of vectors. Sums travel in limbs of 30 bits, so they are exact for all finite components. Errors by
label are added before the shuffle, and joined back without a hot label meeting in one task.

Defined cases: vectors that are null or hold a null, a NaN or an infinity are dropped; an empty vector is kept. Shorter
vectors are filled up with zeros to the length of the longest, rounded up to a multiple of PARTS. Repeated rows count as
often as they come; of equal ids the lesser vector comes first, null ids come last; with fewer vectors than ENTRIES the
codebooks are shorter. Null labels are one label. An error beyond 64 bits is null, and so is the error of its label. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import joined_by_key, materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
SAFE, WIDE = 1 << 26, 256  # parts of up to WIDE components up to SAFE have exact squares in int64
LIMB = 30
UNIT = 2.0**-24  # rounding of float32
MOST = (1 << 63) - 1


# ---- whole numbers of vectors


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE x) of finite doubles: int64 where all are SAFE, else Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    if not scaled.size or np.abs(scaled).max() <= SAFE:
        return scaled.astype(np.int64)
    # doubles from 2^53 on are whole, and 256 times them may overflow
    exact = [int(x) * SCALE if abs(x) >= 2.0**53 else int(np.floor(x * SCALE)) for x in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of finite doubles, filled up with zeros to ``width``."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(np.asarray(vectors.offsets))
    flat = np.asarray(vectors.flatten()).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


# ---- nearest entries


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the index of the nearest row of book, the least of equal ones, and its squared distance."""
    if x.dtype == object or book.dtype == object or x.shape[1] > WIDE:
        return _nearest_exact(x.astype(object), book.astype(object))
    a, b = x.astype(np.float32), book.astype(np.float32)
    squares = (book * book).sum(axis=1)
    own, other = np.sqrt((x * x).sum(axis=1).astype(np.float64)), np.sqrt(squares.astype(np.float64))
    score = squares.astype(np.float64) - 2.0 * (a @ b.T).astype(np.float64)
    # the product's rounding, and that of the float64 steps, with room for their own
    off = 2.02 * (x.shape[1] + 4) * UNIT * np.outer(own, other) + 2.0**-48 * (squares + np.outer(own, other))
    reach = (score + off).min(axis=1)
    row, entry = np.nonzero(score - off <= reach[:, None])  # in order of rows, then of entries
    apart = x[row] - book[entry]
    distance = (apart * apart).sum(axis=1)
    order = np.lexsort((entry, distance, row))
    first = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])] if len(row) else order
    return entry[first], distance[first]


def _nearest_exact(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index, distance = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=object)
    for i, row in enumerate(x.tolist()):
        found = [sum((p - q) ** 2 for p, q in zip(row, entry, strict=True)) for entry in book.tolist()]
        distance[i] = min(found)
        index[i] = found.index(distance[i])
    return index, distance


def _assigned(values: np.ndarray, books: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By part: its whole numbers, entries and distances. Rows that are too large for int64 are done apart."""
    with np.errstate(over="ignore"):
        wide = np.abs(np.floor(values * SCALE)).max(axis=1, initial=0) > SAFE
    step = values.shape[1] // len(books)
    for k, book in enumerate(books):
        part = values[:, k * step : (k + 1) * step]
        if not wide.any():
            x = whole(part)
            yield x, *nearest(x, book)
            continue
        x = np.empty(part.shape, dtype=object)
        index, distance = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=object)
        for rows in (np.flatnonzero(~wide), np.flatnonzero(wide)):
            if len(rows):
                some = whole(part[rows])
                x[rows] = some
                index[rows], distance[rows] = nearest(some, book)
        yield x, index, distance


# ---- jobs


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and label of the rows whose vector is whole and finite."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))  # a NaN is above infinity
    return vectors.select("vec_id", "embedding", "label").where(F.col("embedding").isNotNull() & finite)


SUMS = "part int, entry int, component int, limb int, total long, parts long"


def _sums(books: list[np.ndarray], width: int):
    """Sums of the parts of each entry and how many they are, for each task; limb -1 has the count."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, dtype=object) for b in books]
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            values = matrix(batch.column(0), width)
            for k, (x, index, _) in enumerate(_assigned(values, books)):
                counts[k] += np.bincount(index, minlength=len(books[k]))
                for c in range(x.shape[1]):
                    if x.dtype == object:
                        np.add.at(sums[k][:, c], index, x[:, c])
                    else:  # whole numbers up to 2^26 and a batch of under 2^24 rows: exact in doubles
                        sums[k][:, c] += np.bincount(index, weights=x[:, c], minlength=len(books[k])).astype(np.int64)
        rows = []
        for k, n in enumerate(counts):
            for e in np.flatnonzero(n).tolist():
                rows.append((k, e, -1, -1, 0, int(n[e])))
                for c, v in enumerate(sums[k][e].tolist()):
                    rows += [(k, e, c, i, limb, 0) for i, limb in enumerate(_limbs(int(v)))]
        names = [f.split()[0] for f in SUMS.split(", ")]
        kinds = [pa.int32()] * 4 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=names)

    return of


def _limbs(v: int) -> list[int]:
    sign, v, out = (-1 if v < 0 else 1), abs(v), []
    while v:
        out.append(sign * (v & ((1 << LIMB) - 1)))
        v >>= LIMB
    return out


def _as_book(rows: list[list[int]], step: int) -> np.ndarray:
    book = np.array(rows, dtype=object).reshape(len(rows), step)
    return book.astype(np.int64) if not book.size or max(map(abs, book.ravel().tolist())) <= SAFE else book


def first_books(vectors: DataFrame, width: int, entries: int = ENTRIES, parts: int = PARTS) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids, ascending."""
    least = vectors.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(entries).collect()
    step = width // parts
    values = np.zeros((len(least), width))
    for row, r in zip(values, least, strict=True):
        row[: len(r[0])] = r[0]
    q = whole(values)
    return [_as_book(q[:, k * step : (k + 1) * step].tolist(), step) for k in range(parts)]


def next_books(vectors: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """One round: entries become the floored means of the parts assigned to them; unused ones stay."""
    sums = vectors.select("embedding").mapInArrow(_sums(books, width), SUMS).groupBy("part", "entry", "component", "limb").agg(F.sum("total").alias("total"), F.sum("parts").alias("parts"))
    total: dict[tuple[int, int, int], int] = {}
    count: dict[tuple[int, int], int] = {}
    for r in sums.collect():  # parts x entries x components, and as many limbs as a sum needs
        if r.limb < 0:
            count[r.part, r.entry] = r.parts
        else:
            total[r.part, r.entry, r.component] = total.get((r.part, r.entry, r.component), 0) + (r.total << (LIMB * r.limb))
    out = []
    for k, book in enumerate(books):
        rows = book.tolist()
        for e in range(len(rows)):
            if n := count.get((k, e)):
                rows[e] = [total.get((k, e, c), 0) // n for c in range(book.shape[1])]
        out.append(_as_book(rows, book.shape[1]))
    return out


def _codes(books: list[np.ndarray], width: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, d) for _, i, d in _assigned(matrix(batch.column("embedding"), width), books)]
            codes = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            errors = sum((d.astype(object) for _, d in found), np.zeros(batch.num_rows, dtype=object)).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], type=pa.string()), pa.array([e if e <= MOST else None for e in errors], type=pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return of


def train(vectors: DataFrame, width: int, rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS) -> list[np.ndarray]:
    """The codebooks of all parts; vectors: of :func:`kept`, entries: at most 256."""
    books = first_books(vectors, width, entries, parts)
    for _ in range(rounds if len(books[0]) else 0):
        books = next_books(vectors, books, width)
    return books


def width_of(vectors: DataFrame, parts: int = PARTS) -> int:
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    return -(-longest // parts) * parts


def encode(vectors: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """vec_id, label, code and error of kept vectors."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInArrow(_codes(books, width), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """coded with the column ``vector``: the entries that a code names, as doubles."""

    @F.arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if c is None else [float(v) / SCALE for b, e in zip(books, bytes.fromhex(c), strict=True) for v in b[e].tolist()] for c in batch.to_pylist()], type=pa.list_(pa.float64()))

    return coded.withColumn("vector", of("code"))


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for row in b.tolist() for v in row).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of all kept vectors."""
    own = kept(vectors)
    width = width_of(own)
    books = train(own, width)
    coded = materialize(encode(own, books, width), "codes")
    # sums pass 64 bits; a label with an error that does has none
    exact = F.sum(F.col("error").cast("decimal(20,0)"))
    summed = F.when(F.count("error") == F.count("*"), F.when(exact <= MOST, exact.cast("long"))).alias("label_error")
    labels = materialize(coded.groupBy("label").agg(F.count("*").alias("n"), summed), "labels")
    return joined_by_key(coded, labels, "label", "n").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir):
    return compress(table(spark, sf_dir, "embeddings"))


def oracle_sql() -> str:
    def assigned(book: str) -> str:
        return f"""SELECT v, p, q, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d FROM (
            SELECT v, c.p, q, e, list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - b[i]) * (q[i] - b[i]))) AS d FROM c JOIN {book} USING (p)) GROUP BY v, p, q"""

    rounds = ",\n".join(
        f"""a{r} AS ({assigned(f"b{r}")}),
        m{r} AS (SELECT p, e, list(m ORDER BY i) AS m FROM (SELECT p, e, i, floor(sum(q[i])::DOUBLE / count(*))::BIGINT AS m FROM a{r}, range(1, len(q) + 1) t(i) GROUP BY p, e, i) GROUP BY p, e),
        b{r + 1} AS (SELECT p, e, coalesce(m, b) AS b FROM b{r} LEFT JOIN m{r} USING (p, e))"""
        for r in range(ROUNDS)
    )
    return f"""
    WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS v, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS all_q
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c AS (SELECT v, p, all_q[p * (len(all_q) // {PARTS}) + 1 : (p + 1) * (len(all_q) // {PARTS})] AS q FROM kept, range(0, {PARTS}) t(p)),
    b0 AS (SELECT p, v - 1 AS e, q AS b FROM c WHERE v <= {ENTRIES}),
    {rounds},
    last AS ({assigned(f"b{ROUNDS}")}),
    coded AS (SELECT v, string_agg(lower(lpad(printf('%x', e), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last GROUP BY v),
    sha AS (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, e)) AS s FROM b{ROUNDS})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM kept JOIN coded USING (v), sha
    """

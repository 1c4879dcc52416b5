"""Vector code compression: a codebook for each part of the vectors, by active-entry Lloyd.

Components become whole numbers, floor(4096 x); a vector is cut into 8 equal parts and each part position has a codebook of 16 entries, which starts as
that part of the first 16 vectors. A round assigns every part to its nearest entry and moves each entry to the mean of its parts, rounded down.

Active entries: a row keeps each part's entry and exact distance from the round before. A part whose entry has not moved since compares only the entries that moved
with that distance: what did not move was farther, or as far with a higher index, and still is. Other parts are compared with all entries. Of equal distances the lower index wins, so the result
is that of complete rescans.

How it is spread: a round is one narrow pass that reads the rows, writes them with entries and distances to the shared folder, and writes, for each batch, the
sums and counts of its parts by entry into the same files; reading these sums (a column by itself) gives the next codebooks. Only codebooks (8 x 16 entries) reach the driver and go to the tasks. The
files of a round are deleted once the next round's are there. Errors by label are joined back by broadcast for the at most 1000 labels with over a thousandth of all rows, by a shuffle for the rest.

Edge cases: rows whose vector is null or holds null or non-finite components take no part; null ids come after all others and, as repeated ids, in the order of their vectors, when the first
codebooks are picked; repeated rows get equal codes; with fewer than 16 rows there are as many entries; shorter vectors count as padded with zeros up to the length of the longest, and this up to a multiple of 8; equal entries
stay, the lower index is used; an empty table gives an empty result. Distances are summed in 64 bits where components are below 2**24 in size and vectors no longer than 2**15, else in whole numbers without a limit;
errors end at the limits of a long. Further columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, joined, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGE, WIDE = 1 << 24, 1 << 15  # squares of sums and differences of smaller components fit 64 bits in vectors up to this length
CHUNK = 1 << 12
LIMB_BITS, LIMBS, BIG_BYTES = 32, 36, 512  # for components of any size that a double can have


def whole(vectors: pa.ListArray, width: int, scale: int = SCALE) -> np.ndarray:
    """(n, parts, size) floors of the scaled components; 64-bit numbers, or Python's where some are large."""
    out = np.zeros((len(vectors), width))
    sizes = np.diff(vectors.offsets.to_numpy())
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(out)), sizes), place] = vectors.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        floors = np.floor(out * scale)
    shape = (len(out), PARTS, width // PARTS)
    if width <= WIDE and np.abs(floors).max(initial=0) < LARGE:
        return floors.astype(np.int64).reshape(shape)
    exact = [math.floor(int(x) * scale if abs(x) > 2.0**53 else x * scale) for x in out.ravel().tolist()]
    return np.array(exact, object).reshape(shape)


def nearest(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray | None, distance: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part. ``x`` is (n, parts, size), ``book`` (parts, entries, size), ``moved`` (parts, entries) tells which entries changed
    since ``code`` and ``distance`` were found; without these all entries are compared."""
    n, parts, _ = x.shape
    kind = object if object in (x.dtype, book.dtype) else np.int64
    out, far = np.zeros((n, parts), np.int64), np.zeros((n, parts), kind)
    for p in range(parts):
        fixed = np.zeros(n, bool) if code is None else ~moved[p][code[:, p]]
        if code is not None:
            out[:, p], far[:, p] = code[:, p], distance[:, p]
        for rows, entries in ((np.flatnonzero(~fixed), np.arange(book.shape[1])), (np.flatnonzero(fixed), np.flatnonzero(moved[p]))):
            if not len(rows) or not len(entries):
                continue
            d = ((x[rows, None, p, :] - book[p][None, entries, :]) ** 2).sum(2) if x.shape[2] else np.zeros((len(rows), len(entries)), kind)
            best = d.argmin(1)  # the first of equal ones
            d, e = d[np.arange(len(rows)), best], entries[best]
            if fixed[rows[0]]:
                old, at = far[rows, p], out[rows, p]
                win = (d < old) | ((d == old) & (e < at))
                rows, d, e = rows[win], d[win], e[win]
            out[rows, p], far[rows, p] = e, d
    return out, far


def sums(x: np.ndarray, code: np.ndarray, entries: int) -> list[tuple[int, int, int, int, list[int]]]:
    """(part, entry, count, limb, limbs of the sums of components) of the entries that parts are assigned to. A sum is that of its limbs, limb i times 2**(32 i); the count is in limb 0's row."""
    out = []
    for p in range(x.shape[1]):
        for e in range(entries):
            mine = x[code[:, p] == e, p, :]
            if len(mine):
                total = mine.sum(0)
                last = (LIMBS if x.dtype == object else 2) - 1
                for i in range(last + 1):
                    limb = total >> LIMB_BITS * i if i == last else (total >> LIMB_BITS * i) & ((1 << LIMB_BITS) - 1)
                    out.append((p, e, len(mine) if i == 0 else 0, i, [int(v) for v in limb]))
    return out


def to_bytes(distance: np.ndarray) -> list[bytes]:
    """Each row's distances in 8 bytes each, or, where they may be larger, in 512."""
    if distance.dtype != object:
        return [d.tobytes() for d in distance.astype("<i8")]
    return [b"".join(int(d).to_bytes(BIG_BYTES, "little") for d in row) for row in distance]


def from_bytes(stored: list[bytes], large: bool) -> np.ndarray:
    if not large and all(len(b) == 8 * PARTS for b in stored):
        return np.frombuffer(b"".join(stored), "<i8").reshape(-1, PARTS)
    rows = [[int.from_bytes(b[i : i + len(b) // PARTS], "little") for i in range(0, len(b), len(b) // PARTS)] for b in stored]
    return np.array(rows, object).reshape(-1, PARTS)


def clean(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """k, v, label of the rows that take part."""
    v = F.col(vector_col)
    v = v if dict(vectors.dtypes)[vector_col] == "array<float>" else v.cast("array<double>")
    bad = F.exists(v.cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(v.isNotNull() & ~bad).select(F.col(id_col).alias("k"), v.alias("v"), F.col(label_col).alias("label"))


def assign(rows: DataFrame, book: np.ndarray, moved: np.ndarray, width: int, again: bool) -> DataFrame:
    """``rows`` (k, v, label and, with ``again``, code and distance) with code (a byte for each part), distance and error, and rows that have ``part``, ``entry``, ``n``, ``limb`` and
    ``total`` only: a batch's sums."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, CHUNK):
                batch = whole_batch.slice(lo, CHUNK)
                x = whole(batch.column("v"), width)
                code = distance = None
                if again:
                    code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64)
                    distance = from_bytes(batch.column("distance").to_pylist(), x.dtype == object or book.dtype == object)
                code, distance = nearest(x, book, moved, code, distance)
                added = sums(x, code, book.shape[1])
                n, m = batch.num_rows, len(added)
                error = [min(int(d), 2**63 - 1) for d in distance.astype(object).sum(1)] if distance.dtype == object else distance.sum(1).tolist()
                columns = [pa.concat_arrays([batch.column(c), pa.nulls(m, batch.column(c).type)]) for c in ("k", "v", "label")]
                columns.append(pa.array([c.astype(np.uint8).tobytes() for c in code] + [None] * m, pa.binary()))
                columns.append(pa.array(to_bytes(distance) + [None] * m, pa.binary()))
                columns.append(pa.array(error + [None] * m, pa.int64()))
                columns += [pa.array([None] * n + [a[i] for a in added], pa.int64()) for i in range(4)]
                columns.append(pa.array([None] * n + [a[4] for a in added], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["k", "v", "label", "code", "distance", "error", "part", "entry", "n", "limb", "total"])

    own = ", ".join(f"{c} {kinds[c]}" for c in ("k", "v", "label"))
    return rows.mapInArrow(run, f"{own}, code binary, distance binary, error long, part long, entry long, n long, limb long, total array<long>")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """k (the id), code (a byte for each part), error (the sum of its distances) and label of every row, and the codebooks, (parts, entries, size)."""
    rows = clean(vectors, id_col, vector_col, label_col)
    wide = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-wide // PARTS) * PARTS
    seeds = rows.select("k", "v").orderBy(F.col("k").asc_nulls_last(), F.col("v").cast("array<double>")).limit(entries).collect()
    book = whole(pa.array([r["v"] for r in seeds], pa.list_(pa.float64())), width).transpose(1, 0, 2)
    if not len(seeds):
        return materialize(assign(rows, book, np.zeros((PARTS, 0), bool), width, False).select("k", "code", "error", "label"), "codes"), book
    moved, state = np.ones(book.shape[:2], bool), None
    for _ in range(rounds):
        new = materialize(assign(rows if state is None else state.where("part is null"), book, moved, width, state is not None), "codes")
        if state is not None:
            discard(state)
        state = new
        found = state.where("part is not null").select("part", "entry", "n", "limb", F.posexplode("total").alias("at", "t"))
        found = found.groupBy("part", "entry", "at", "limb").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect()  # components of the codebooks
        count, total = {}, {}
        for r in found:
            at = (r["part"], r["entry"], r["at"])
            count[at], total[at] = count.get(at, 0) + r["n"], total.get(at, 0) + (r["t"] << LIMB_BITS * r["limb"])
        before, book = book, book.copy()
        means = {at: t // count[at] for at, t in total.items()}
        if means and max(map(abs, means.values())) >= LARGE:
            book = book.astype(object)
        for at, mean in means.items():
            book[at] = mean
        moved = np.array((book != before).any(2), bool)
    last = materialize(assign(state.where("part is null"), book, moved, width, True).where("part is null").select("k", "code", "error", "label"), "codes")
    discard(state)
    return last, book


def op12_vector_codes(spark, sf_dir):
    """vec_id, code, error, label_error, codebooks_sha256 for every vector that takes part."""
    coded, book = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(str(int(v)) for v in book.ravel()).encode()).hexdigest()
    top = F.lit(2**63 - 1).cast("decimal(38,0)")
    # a byte below 16 is two hex digits
    rows = coded.select(F.col("k").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label")
    by_label = rows.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), top).cast("long").alias("label_error"), F.count("*").alias("label_rows"))
    return joined(rows, "label", materialize(by_label, "labels"), "label_rows").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """Complete rescans, a CTE for each step."""
    out = ["""WITH e AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, [CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT) for c in embedding] AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
x AS MATERIALIZED (SELECT r, p, x[p * len(x) // 8 + 1 : (p + 1) * len(x) // 8] AS x FROM e, range(8) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS j, x AS b FROM x WHERE r <= 16)"""]
    for i in range(ROUNDS + 1):
        dist = "CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x, b)]) AS BIGINT)"
        out.append(f"a{i} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min(struct_pack(d := {dist}, j := j)) AS m FROM x JOIN b{i} USING (p) GROUP BY r, p)")
        if i < ROUNDS:
            mean = f"SELECT p, j, list(b ORDER BY ix) AS b FROM (SELECT p, j, ix, CAST(sum(v)::HUGEINT // count(*) - CASE WHEN sum(v) < 0 AND sum(v)::HUGEINT % count(*) <> 0 THEN 1 ELSE 0 END AS BIGINT) AS b FROM (SELECT p, m.j AS j, unnest(range(len(x))) AS ix, unnest(x) AS v FROM a{i}) GROUP BY p, j, ix) GROUP BY p, j"
            out.append(f"n{i} AS MATERIALIZED ({mean}), b{i + 1} AS MATERIALIZED (SELECT p, j, coalesce(n.b, o.b) AS b FROM b{i} o LEFT JOIN n{i} n USING (p, j))")
    last = ROUNDS
    out.append(f"""f AS (SELECT r, string_agg(printf('%02x', m.j), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{last} GROUP BY r),
g AS (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, j)) AS s FROM b{last})""")
    return ",\n".join(out) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, g.s AS codebooks_sha256 FROM e JOIN f USING (r), g"


OP12_SQL = _sql()

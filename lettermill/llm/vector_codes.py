"""Vector code compression: product codes whose nearest entries are found in vantage-point trees.

Vectors become integers and are cut into equal parts. Each part position has a codebook, and a
vantage-point tree over its entries. A part goes down to its home first, which gives a bound, and then
visits each branch that can hold an entry as near. Distances from vantage points to what is below them
are rounded outwards, branches at exactly the bound are visited too, and every entry is judged by its
integer distance, so ties and results are those of a full comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_tables, table, with_columns, written

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096


class Node:
    """A vantage entry, and the branches of nearer and farther entries, each with the least and the
    largest distance from the vantage entry, rounded outwards."""

    def __init__(self, entries: np.ndarray, numbers: list[int]):
        self.at, rest = numbers[0], numbers[1:]
        self.branches: list[tuple[float, float, Node]] = []
        self.middle = np.inf
        if rest:
            far = np.sqrt(squares(entries[rest], entries[self.at]).astype(float))
            order = np.argsort(far, kind="stable")
            half = (len(rest) + 1) // 2
            self.middle = float(far[order[half - 1]])
            for part in (order[:half], order[half:]):
                if len(part):
                    own = far[part]
                    self.branches.append((np.nextafter(own.min(), 0), np.nextafter(own.max(), np.inf), Node(entries, [rest[i] for i in part])))


def squares(rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows to one entry."""
    apart = rows - entry
    return np.einsum("ij,ij->i", apart, apart)


class Tree:
    """A vantage-point tree over one codebook (integers, a row for each entry)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = Node(entries, list(range(len(entries))))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of the nearest entry, of equally near ones the lowest, and the
        squared distance."""
        best = np.full(len(rows), np.iinfo(np.int64).max)
        at = np.full(len(rows), len(self.entries))
        self._descend(self.root, rows, np.arange(len(rows)), best, at)
        self._sweep(self.root, rows, np.arange(len(rows)), best, at)
        return at, best

    def _judge(self, node: Node, rows: np.ndarray, who: np.ndarray, best: np.ndarray, at: np.ndarray) -> np.ndarray:
        found = squares(rows[who], self.entries[node.at])
        better = (found < best[who]) | (found == best[who]) & (node.at < at[who])
        best[who[better]], at[who[better]] = found[better], node.at
        return np.sqrt(found.astype(float))

    def _descend(self, node: Node, rows: np.ndarray, who: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        """Each row goes into one branch only."""
        if len(who):
            near = self._judge(node, rows, who, best, at) <= node.middle
            for (_, _, below), go in zip(node.branches, (near, ~near)):
                self._descend(below, rows, who[go], best, at)

    def _sweep(self, node: Node, rows: np.ndarray, who: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        """Each row goes into the branches whose nearest possible entry isn't farther than its best."""
        far = self._judge(node, rows, who, best, at)
        low, high = np.nextafter(far, 0), np.nextafter(far, np.inf)
        for least, most, below in node.branches:
            gap = np.maximum(0, np.maximum(np.nextafter(low - most, -np.inf), np.nextafter(least - high, -np.inf)))
            may = np.nextafter(gap * gap, 0) <= np.nextafter(best[who].astype(float), np.inf)
            if may.any():
                self._sweep(below, rows, who[may], best, at)


def assign(vectors: np.ndarray, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """Entry numbers (a row for each vector, a column for each part) and squared distances, of
    vectors as (vector, part, position)."""
    found = [tree.nearest(np.ascontiguousarray(vectors[:, p])) for p, tree in enumerate(trees)]
    return np.stack([n for n, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _matrix(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """Integer vectors as (vector, part, position); shorter ones end in zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(len(sizes), parts, width // parts)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out.reshape(len(sizes), parts, width // parts)


SUMS = T.StructType([T.StructField(c, T.LongType()) for c in ("part", "entry", "position", "n", "total")])


def _sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, position, n, total) of what is assigned to each entry: one set of rows a task."""
    parts, entries, width = books.shape
    books = books.copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        n, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            own = _matrix(batch.column(0), parts * width, parts)
            at, _ = assign(own, trees)
            for p in range(parts):
                np.add.at(n[p], at[:, p], 1)
                np.add.at(total[p], at[:, p], own[:, p])
        used = [x for x in np.ndindex(books.shape) if n[x[:2]]]
        if used:
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in used], pa.int64()) for k in range(3)), pa.array([int(n[x[:2]]) for x in used], pa.int64()), pa.array([int(total[x]) for x in used], pa.int64())], names=SUMS.names)

    return vectors.select("ints").mapInArrow(run, SUMS)


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """rows with `ints`, floor(scale * x) of each component, instead of `embedding`; without rows
    whose vector is null or has a component that is null or isn't finite."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(True)))
    return good.withColumn("ints", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))).drop("embedding")


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The final codebooks, as (part, entry, position), of `ints`.

    What goes to the driver is the seeds and, each round, one sum for each of the codebooks'
    numbers: a size that doesn't grow with the rows.
    """
    size, most = vectors.agg(F.max(F.size("ints")), F.max(F.array_max(F.transform("ints", F.abs)))).first()
    width = -(-(size or 0) // parts) * parts
    if most is not None and width * (2 * most + 1) ** 2 >= 1 << 62:
        raise OverflowError("components are too large for exact distances in 64 bits")
    seeds = vectors.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("ints").alias("ints")).orderBy("vec_id").limit(entries).collect()
    books = np.zeros((len(seeds), width), np.int64)
    for i, seed in enumerate(seeds):
        books[i, : len(seed["ints"])] = seed["ints"]
    books = np.ascontiguousarray(books.reshape(len(seeds), parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds if len(seeds) and width else 0):
        now = books.copy()
        for r in _sums(vectors, books).groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            now[r["part"], r["entry"], r["position"]] = r["total"] // r["n"]
        if (now == books).all():  # nothing changes any more
            break
        books = now
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


CODES = T.StructType([T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])


def code_column(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vectors with code (entry numbers in order of parts, two hexadecimal digits each) and error (squared
    distances summed over parts), instead of `ints`."""
    books = books.copy()
    parts, entries, width = books.shape

    def start():
        trees = [Tree(b) for b in books] if entries else []

        def step(rows):
            own = rows["ints"]
            if not entries or not len(own):
                return {"code": pa.array([""] * len(own), pa.string()), "error": pa.array([0] * len(own), pa.int64())}
            at, far = assign(_matrix(own, parts * width, parts), trees)
            return {"code": pa.array([bytes(x).hex() for x in at.astype(np.uint8)], pa.string()), "error": pa.array(far.sum(axis=1), pa.int64())}

        return step

    return with_columns(vectors, ["ints"], CODES, start, lists=False, without=["ints"])


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(rows with code, error, label_error and codebooks_sha256 instead of `embedding`; the codebooks).

    rows have vec_id, embedding and label; of further columns, those with names of the new ones are
    replaced and others stay. Rows whose vector is null, or has components that are null or not
    finite, are left out; an empty table gives no rows. Vectors that are shorter than the longest,
    or than a multiple of the parts, count as ended by zeros. Repeated rows each count and return.
    A repeated vec_id is one seed, its least vector; rows without a vec_id are no seeds but take part
    otherwise. With fewer than 16 ids there are fewer entries; with none, codes are empty and errors 0.
    label_error is the error summed over equal labels, null ones together. At most 256 entries.
    Components so large that 64 bits don't hold the distances are an error.

    The integers are stored once; each round reads them and returns sums only.
    """
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits")
    scratch: list[str] = []
    new = ("code", "error", "label_error", "codebooks_sha256", "ints")
    vectors = written(integers(rows.drop(*(c for c in rows.columns if c.lower() in new))), scratch)
    books = codebooks(vectors, parts, entries, rounds)
    coded = written(code_column(vectors, books))
    # Summed first and stored, so a label with very many rows is a join that Spark can split.
    each = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own label"))
    out = coded.join(each, F.col("label").eqNullSafe(F.col("own label"))).drop("own label")
    drop_tables(rows.sparkSession, scratch)
    return out.withColumn("codebooks_sha256", F.lit(digest(books))), books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return compress(vectors)[0].select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def brute(rows: list[tuple], parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[tuple]:
    """(vec_id, code, error, label_error, codebooks_sha256) of (vec_id, vector, label) with vectors of
    one length, by comparing with each entry in plain integers: for tests."""
    import math

    kept = [(k, [math.floor(SCALE * x) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts if kept else 0
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    least = dict(sorted(((k, v) for k, v, _ in kept if k is not None), reverse=True))
    books = [[cut(least[k])[p] for k in sorted(least)[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members: dict[int, list] = {}
            for _, v, _ in kept:
                members.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(x) // len(members[i]) for x in zip(*members[i], strict=True)] if i in members else e for i, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [(k, [near(x, books[p]) for p, x in enumerate(cut(v))], label) for k, v, label in kept]
    by_label: dict = {}
    for _, parts_of, label in found:
        by_label[label] = by_label.get(label, 0) + sum(d for d, _ in parts_of)
    return [(k, "".join(f"{i:02x}" for _, i in parts_of), sum(d for d, _ in parts_of), by_label[label], sha) for k, parts_of, label in found]


def _sql() -> str:
    nearest = "SELECT vec_id, part, p.c AS c, min({{'d': list_sum(list_transform(list_zip(p.c, e.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'entry': entry}}) AS best FROM p JOIN e{r} e USING (part) GROUP BY ALL"
    text = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS (
  SELECT vec_id, part, list_slice(q, part * (len(q) // {PARTS}) + 1, (part + 1) * (len(q) // {PARTS})) AS c FROM v CROSS JOIN (SELECT unnest(range({PARTS})) AS part)
), e0 AS (
  SELECT part, dense_rank() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES})
)"""
    for r in range(ROUNDS):
        text += f""", a{r} AS MATERIALIZED ({nearest.format(r=r)}), s{r} AS (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
    SELECT part, best.entry AS entry, i, sum(c[i]) AS s, count(*) AS n FROM (SELECT part, best, c, unnest(range(1, len(c) + 1)) AS i FROM a{r}) GROUP BY ALL) GROUP BY ALL
), e{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(s.c, e.c) AS c FROM e{r} e LEFT JOIN s{r} s USING (part, entry))"""
    return text + f""", a AS ({nearest.format(r=ROUNDS)}), o AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(best.entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM e{ROUNDS}) AS codebooks_sha256
FROM o JOIN v USING (vec_id)
"""


SQL = _sql()

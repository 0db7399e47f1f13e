"""Which files of a stored table can hold a text, so that a search for it reads no others.

For each file a map of bits says which pieces of four bytes its messages' lower-cased texts have. A
search text can only be in a file that has all of its pieces. Maps are kept beside the table, by
generation; generations never change, so each is indexed once, and one that isn't is read as a whole.
The search itself then tests what those files hold as any other search does.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.criteria import Needed, needed
from ..operators.select import INBOX, search
from ..schema import MESSAGE
from .stored import GEN, Store

PIECE, BITS = 4, 1 << 18
ROW = T.StructType([T.StructField("file", T.StringType()), T.StructField("chunk", T.IntegerType()), T.StructField("bits", T.LongType())])


def places(text: bytes) -> np.ndarray:
    """The bits of a text's pieces; none for shorter texts."""
    if len(text) < PIECE:
        return np.empty(0, np.int64)
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    pieces = sum(raw[k : len(raw) - PIECE + 1 + k] << np.uint64(8 * k) for k in range(PIECE))
    return np.unique((pieces * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(BITS)).astype(np.int64)


def _text() -> Column:
    """All that a search looks at, lower-cased as it does."""
    lists = F.concat_ws("\n", "to", "cc", F.flatten(F.map_values("headers")))
    return F.lower(F.concat_ws("\n", "subject", "from", lists, "bodyText", "html"))


def _maps(rows: DataFrame) -> DataFrame:
    """(file, chunk, bits): the bits of rows (file, text), 64 in each chunk; chunks without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: str | None = None
        bits = np.zeros(BITS, np.uint8)

        def shown() -> pa.RecordBatch:
            longs = np.packbits(bits, bitorder="little").view(np.int64)
            at = np.flatnonzero(longs)
            return pa.RecordBatch.from_arrays([pa.array([now] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(longs[at])], names=ROW.names)

        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != now:
                    if now is not None:
                        yield shown()
                    now = file
                    bits[:] = 0
                bits[places(text.encode())] = 1
        if now is not None:
            yield shown()

    return rows.mapInArrow(run, ROW).groupBy("file", "chunk").agg(F.bit_or("bits").alias("bits"))


class TextIndex:
    def __init__(self, table: Store):
        self.table, self.spark = table, table.spark

    def _at(self, gen: str) -> str:
        return f"{self.table.path}/_text/gen={gen}"

    def _has(self, gen: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._at(gen)}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def build(self) -> int:
        """Indexes the latest version's generations that aren't yet; how many these were."""
        fresh = [g for g in sorted(self.table.version().generations()) if not self._has(g)]
        for gen in fresh:
            rows = self.spark.read.schema(MESSAGE).parquet(f"{self.table.path}/data/gen={gen}").select(F.col("_metadata.file_path").alias("file"), _text().alias("text"))
            _maps(rows).sort("chunk").write.mode("overwrite").parquet(self._at(gen))
        return len(fresh)

    def files(self, wanted: Needed) -> list[str]:
        """Files of indexed generations that can hold what is wanted. Their names go to the driver, as those of
        all that Spark reads do."""
        gens = [g for g in sorted(self.table.version().generations()) if self._has(g)]
        if not gens:
            return []
        parts = sorted(_parts(wanted))
        maps = self.spark.read.schema(ROW).parquet(*map(self._at, gens))
        masks: list[dict[int, int]] = []
        for part in parts:
            bits = np.zeros(BITS, np.uint8)
            bits[places(part.encode())] = 1
            longs = np.packbits(bits, bitorder="little").view(np.int64)
            masks.append({int(c): int(longs[c]) for c in np.flatnonzero(longs)})
        has = []
        for k, mask in enumerate(masks):
            asked = F.try_element_at(F.create_map(*(F.lit(x) for pair in mask.items() for x in pair)), F.col("chunk")) if mask else F.lit(None).cast("long")
            has.append(F.count_if(F.col("bits").bitwiseAND(asked) == asked).alias(f"has_{k}"))
        chunks = sorted({c for mask in masks for c in mask})
        # Files without any of these chunks can hold nothing that has a piece in them; but all can hold a short part.
        every = maps.select("file").distinct()
        found = every.join(maps.where(F.col("chunk").isin(chunks)).groupBy("file").agg(*has), "file", "left").fillna(0)
        test = _holds(wanted, {part: F.col(f"has_{k}") == len(masks[k]) for k, part in enumerate(parts)})
        return [unquote(r["file"]) for r in found.where(test).select("file").collect()]

    def search(self, criteria, folder: str | None = INBOX) -> DataFrame:
        """What `select.search` finds in the table, read from the files that can have it."""
        version, wanted = self.table.version(), needed(criteria)
        rest = [g for g in sorted(version.generations()) if not self._has(g)]
        if wanted is None or len(rest) == len(version.generations()):
            return search(self.table.read(), criteria, folder)
        paths = [*self.files(wanted), *(f"{self.table.path}/data/gen={g}" for g in rest)]
        if not paths:
            return search(self.spark.createDataFrame([], MESSAGE), criteria, folder)
        every = self.spark.read.schema(T.StructType([*MESSAGE.fields, GEN])).option("basePath", f"{self.table.path}/data").parquet(*paths)
        return search(every.where(version.live()).drop("gen"), criteria, folder)


def _parts(wanted: Needed) -> set[str]:
    return {wanted} if isinstance(wanted, str) else set().union(*map(_parts, wanted[1]))


def _holds(wanted: Needed, has: dict[str, Column]) -> Column:
    if isinstance(wanted, str):
        return has[wanted]
    return reduce((lambda a, b: a & b) if wanted[0] == "and" else (lambda a, b: a | b), (_holds(w, has) for w in wanted[1]))

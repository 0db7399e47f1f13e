"""Removal of repeated 200-byte strings by suffix sorting.

Every byte that is covered by a 200-byte string which starts somewhere else too is removed. No
task sees the whole corpus, so suffixes are sorted only where they can matter:

* A gram is an anchor where its hash is the least in some 200-byte window. Equal windows have
  their anchors in the same places, so a repeated window holds a repeated anchor.
* Each window with an anchor reaches at least 84 bytes to the left or to the right of it. The
  anchor with those bytes is a core of 116 bytes; a window shared by two places lies around equal
  cores. The bytes around a core that its windows can reach are its margins.
* Cores with equal margins are one class. A class at several places is repeated as far as it
  reaches. Classes with equal cores and different margins are compared by suffix sorting: the
  suffixes that begin at the core, and the reversed ones that end before it, in deep-shallow order.
* Where very many classes have one core, the core grows first: a shared window has half of the
  bytes that it still lacks on the left or half on the right, so each class goes to a group for
  either, and so on until groups are small, or their core is a whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_tables, rows_from, table, text_of, written
from .near_dedup import P1, mix
from .suffixes import Node, blind_trie, common, deep_shallow

LENGTH = 200
GRAM = 32
MARGIN = (LENGTH - GRAM) // 2
CORE = GRAM + MARGIN
MANY = 256  # classes of one core beyond which the core grows
AT_ONCE = 1 << 22  # grams whose anchors are found together; below 2**PLACE_BITS
PLACE_BITS = 24

_POWERS = np.empty(0, np.uint64)
_BACK = np.empty(0, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _BACK
    if len(_POWERS) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = np.uint64(pow(int(P1), -1, 1 << 64))
        _POWERS, _BACK = (np.cumprod(np.full(size, base, np.uint64)) * np.uint64(pow(int(base), -1, 1 << 64)) for base in (P1, inverse))
    return _POWERS[:n], _BACK[:n]


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each run of `gram` bytes."""
    n = len(raw)
    powers, back = _powers(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers)))
    return mix((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors: of each window, the leftmost gram of least hash."""
    places, hashes = [], []
    wide = length - gram + 1
    raw = np.frombuffer(text, np.uint8)
    for begin in range(0, len(text) - length + 1, AT_ONCE):
        own = gram_hashes(raw[begin : begin + AT_ONCE + length - 1], gram)
        low = np.uint64((1 << PLACE_BITS) - 1)
        value = (own & ~low) | np.arange(len(own), dtype=np.uint64)
        windows = len(own) - wide + 1
        padded = np.full(-(-len(own) // wide) * wide, ~np.uint64(0), np.uint64)
        padded[: len(own)] = value
        block = padded.reshape(-1, wide)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows])
        at = (least[np.flatnonzero(np.diff(least, prepend=~np.uint64(0)))] & low).astype(np.int64)
        places.append(at + begin)
        hashes.append(own[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def spots(key: bytes, places: np.ndarray) -> np.ndarray:
    """A number for each place in the text of this key."""
    return mix(np.uint64(int.from_bytes(key[:8])) ^ mix(places.astype(np.uint64) + np.uint64(int.from_bytes(key[8:]))))


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def anchor_rows(texts: DataFrame, with_place: bool) -> DataFrame:
    """(anchor, spot), or (anchor, text_key, place), of the anchors of each text."""

    def start():
        def step(rows):
            found = [(key, *anchors(text.encode())) for key, text in zip(rows["text_key"], rows["text"], strict=True)]
            out = {"anchor": signed(np.concatenate([h for _, _, h in found])) if found else []}
            if with_place:
                out["text_key"] = [key for key, p, _ in found for _ in range(len(p))]
                out["place"] = np.concatenate([p for _, p, _ in found]).astype(np.int32) if found else []
            else:
                out["spot"] = signed(np.concatenate([spots(key, p) for key, p, _ in found])) if found else []
            return out

        return step

    fields = _schema(anchor=T.LongType(), text_key=T.BinaryType(), place=T.IntegerType()) if with_place else _schema(anchor=T.LongType(), spot=T.LongType())
    return rows_from(texts, ["text_key", "text"], fields, start)


CORES = _schema(core=T.LongType(), margins=T.LongType(), row=T.LongType(), place=T.IntegerType())


def core_rows(texts: DataFrame) -> DataFrame:
    """The cores at the places of the texts' repeated anchors."""

    def start():
        def step(rows):
            out: dict[str, list] = {name: [] for name in CORES.names}
            for row, text, places in zip(rows["row"], rows["text"], rows["places"], strict=True):
                raw = text.encode()
                own = sorted({c for p in places for c in (p, p - MARGIN) if c >= 0 and c + CORE <= len(raw)})
                for c in own:
                    left = min(c, MARGIN)
                    out["core"].append(xxhash.xxh3_64_intdigest(raw[c : c + CORE]) - (1 << 63))
                    out["margins"].append(xxhash.xxh3_64_intdigest(raw[c - left : c + LENGTH], seed=left) - (1 << 63))
                out["row"] += [row] * len(own)
                out["place"] += own
            return out

        return step

    return rows_from(texts, ["row", "text", "places"], CORES, start)


AROUND = _schema(core=T.LongType(), margins=T.LongType(), left=T.BinaryType(), right=T.BinaryType())


def around_rows(texts: DataFrame) -> DataFrame:
    """The bytes around the places listed in `wanted`."""

    def start():
        def step(rows):
            out: dict[str, list] = {name: [] for name in AROUND.names}
            for text, wanted in zip(rows["text"], rows["wanted"], strict=True):
                raw = text.encode()
                for w in wanted:
                    c = w["place"]
                    out["core"].append(w["core"])
                    out["margins"].append(w["margins"])
                    out["left"].append(raw[max(0, c - MARGIN) : c][::-1])
                    out["right"].append(raw[c : c + LENGTH])
            return out

        return step

    return rows_from(texts, ["text", "wanted"], AROUND, start)


def reach(lefts: list[bytes], rights: list[bytes]) -> list[tuple[int, int]]:
    """For each class of a core: how far to the left of the core, and from its start to the right,
    the windows go that another of the classes shares; (0, 0) if none does.

    lefts are reversed. Suffixes are put in order once for each direction; for the members of each
    fork of the left ones, the nearest in the right order has the longest common right part.
    """
    n = len(lefts)
    out = [(0, 0)] * n

    def tell(i: int, left: int, right: int) -> None:
        if left + right >= LENGTH:
            out[i] = (max(out[i][0], left), max(out[i][1], right))

    if n == 2:
        left, right = common(lefts[0], lefts[1]), common(rights[0], rights[1])
        if right >= CORE:
            tell(0, left, right)
            tell(1, left, right)
        return out
    rank = [0] * n
    for r, i in enumerate(deep_shallow(rights)):
        rank[i] = r
    order = deep_shallow(lefts)

    def settle(members: list[int], depth: int) -> None:
        members.sort(key=rank.__getitem__)
        near = [common(rights[a], rights[b]) for a, b in zip(members, members[1:])]
        for k, i in enumerate(members):
            best = max(near[k - 1] if k else 0, near[k] if k < len(near) else 0)
            if best >= CORE:
                tell(i, depth, best)

    stack, done = [blind_trie(lefts, order)], []
    while stack:  # forks come before what is below them
        node = stack.pop()
        done.append(node)
        stack += node.children.values()
    members: dict[int, list[int]] = {}
    for node in reversed(done):
        own = list(node.members or ()) + [i for child in node.children.values() for i in members.pop(id(child))]
        members[id(node)] = own
        if len(own) > 1:
            settle(own, node.depth)
    return out


REACH = _schema(core=T.LongType(), margins=T.LongType(), low=T.IntegerType(), high=T.IntegerType())


def grown(rows: DataFrame) -> DataFrame:
    """rows of groups whose core is to grow, once for either side that has the bytes."""
    half = F.ceil((MARGIN - F.col("a") - F.col("b")) / 2).cast("int")
    sides = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("b") + half).alias("b")))
    out = rows.select("core", "margins", "left", "right", F.explode(sides).alias("side")).select("core", "margins", "left", "right", "side.*")
    out = out.where((F.octet_length("left") >= F.col("a")) & (F.octet_length("right") >= CORE + F.col("b")))
    return out.withColumn("group", F.xxhash64("core", "a", "b", F.substring("left", F.lit(1), F.col("a")), F.substring("right", F.lit(CORE + 1), F.col("b"))))


def marked(around: DataFrame, scratch: list[str], many: int = MANY) -> DataFrame:
    """(core, margins, low, high): which bytes from the core's place on are repeated, of classes
    with one core. Every group that is sorted has at most `many` classes. What is found is stored
    turn by turn, and a turn's rows go when the next one's are stored."""
    spark = around.sparkSession
    rows = around.select("*", F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("core").alias("group"))
    found, before, shared = [], [], 0  # shared: how many bytes a group's rows have in common beyond the core
    while True:
        now: list[str] = []
        rows = written(rows, now)
        drop_tables(spark, before)
        sizes = written(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), scratch)
        found.append(written(compared(rows.join(sizes.where(F.col("n") <= many).select("group"), "group")), scratch))
        large = sizes.where(F.col("n") > many).select("group")
        last = large.isEmpty()
        rows = rows.join(large, "group")
        if shared == MARGIN and not last:  # all of such a group share a whole window
            found.append(written(rows.select("core", "margins", (-F.col("a")).alias("low"), (F.col("b") + CORE).alias("high")), scratch))
        if shared == MARGIN or last:
            drop_tables(spark, now)
            return reduce(DataFrame.unionAll, found)
        rows, before = grown(rows), now
        shared += -(-(MARGIN - shared) // 2)


def compared(grouped: DataFrame) -> DataFrame:
    """(core, margins, low, high): which bytes from the core's place on are repeated within a group.

    Rows of a group come together by a shuffle and a sort within partitions; a task holds those of
    one group at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        group: list[tuple] = []

        def close() -> None:
            if len(group) > 1:
                for (_, core, margins, *_), (left, right) in zip(group, reach([g[3] for g in group], [g[4] for g in group]), strict=True):
                    if right:
                        out.append((core, margins, -left, right))
            group.clear()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=REACH.names)

        for part in batches:
            for row in zip(*(part.column(name).to_pylist() for name in ("group", *AROUND.names)), strict=True):
                if group and group[0][0] != row[0]:
                    close()
                group.append(row)
            if len(out) > 10_000:
                yield batch()
                out.clear()
        close()
        yield batch()

    return grouped.select("group", *AROUND.names).repartition("group").sortWithinPartitions("group").mapInArrow(run, REACH)


RESULT = _schema(row=T.LongType(), n_removed=T.LongType(), n_spans=T.LongType(), kept_sha256=T.StringType(), spans=T.ArrayType(_schema(start=T.IntegerType(), end=T.IntegerType())))


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left without the spans, and the maximal runs that they make."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    keep, last = [], 0
    for a, b in runs:
        keep.append(text[last:a])
        last = b
    return b"".join([*keep, text[last:]]), [(a, b) for a, b in runs]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(text_key, n_removed, n_spans, kept_sha256, spans) of the distinct texts that share a
    200-byte string with another place of a distinct text. docs: text_key (16 bytes), text."""
    places = anchor_rows(docs, False).groupBy("anchor").agg(F.min("spot").alias("low"), F.max("spot").alias("high"))
    scratch: list[str] = []
    repeated = written(places.where("low <> high").select("anchor"), scratch)
    at = anchor_rows(docs, True).join(repeated, "anchor", "left_semi").groupBy("text_key").agg(F.collect_set("place").alias("places"))
    distinct = docs.groupBy("text_key").agg(F.first("text").alias("text"))
    texts = written(distinct.join(at, "text_key").withColumn("row", F.monotonically_increasing_id()))  # the numbers stay, once written

    cores = written(core_rows(texts))
    spot = F.xxhash64("row", "place")
    classes = cores.groupBy("core", "margins").agg(F.min(spot).alias("low"), F.max(spot).alias("high"), F.first("row").alias("row"), F.first("place").alias("place"))
    classes = written(classes, scratch)
    several = classes.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    wanted = classes.join(several, "core").groupBy("row").agg(F.collect_list(F.struct("core", "margins", "place")).alias("wanted"))
    found = marked(around_rows(texts.select("row", "text").join(wanted, "row")), scratch)
    whole = classes.where("low <> high").select("core", "margins", F.lit(-MARGIN).alias("low"), F.lit(LENGTH).alias("high"))
    # All that is said of a class holds its core, and so together is one run of bytes.
    # Stored, so that the join after it can split a class with very many places.
    marks = written(found.unionAll(whole).groupBy("core", "margins").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    drop_tables(docs.sparkSession, scratch)
    spans = cores.join(marks, ["core", "margins"])
    spans = spans.select("row", F.greatest(F.lit(0), F.col("place") + F.col("low")).alias("start"), (F.col("place") + F.col("high")).alias("end"))
    spans = spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def start():
        def step(rows):
            out: dict[str, list] = {name: [] for name in RESULT.names}
            for row, text, own in zip(rows["row"], rows["text"], rows["spans"], strict=True):
                raw = text.encode()
                kept, runs = cut(raw, [(s["start"], min(s["end"], len(raw))) for s in own])
                for name, value in zip(RESULT.names, (row, len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in runs]), strict=True):
                    out[name].append(value)
            return out

        return step

    # The texts are dealt by row for this join as for that above: Spark deals them once.
    found = rows_from(texts.select("row", "text").join(spans, "row"), ["row", "text", "spans"], RESULT, start)
    return found.join(texts.select("row", "text_key"), "row").drop("row")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end in bytes) for each row.

    Null and empty texts have no bytes; a text of under 200 bytes loses none. All rows count as
    places, with or without an id, repeated ones too: a text that several rows have goes whole.
    Texts are bytes; what is kept need not be valid UTF-8. Other columns are ignored. An empty
    table gives no rows.

    Copies of a text are handled once: their rows all have the same result. Runs of a short period
    have an anchor in each period, still at most one for each byte.
    """
    keyed = docs.select("doc_id", text_of().alias("text")).withColumn("text_key", F.unhex(F.md5("text")))
    long = keyed.where(F.octet_length("text") >= LENGTH).select("text_key", "text")
    found = repeated_spans(long)
    copies = long.groupBy("text_key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    own = keyed.select("doc_id", "text_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    out = own.join(copies, "text_key", "left").join(found, "text_key", "left")
    whole = F.col("rows").isNotNull()
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    return out.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, all_of_it).otherwise(F.col("spans")).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).drop("spans")


def brute(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """(n_removed, n_spans, kept_sha256) by a table of all windows: for tests."""
    from collections import Counter

    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        kept, runs = cut(t, [(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1])
        out.append((len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return out

"""Near-duplicate documents by HyperMinHash.

A document's five-word shingles are hashed once each. The hash chooses a bucket; the bucket keeps
its smallest remainder, compressed to a leading-zero count and mantissa bits. Buckets that stay
empty take the register of another, by a fixed order. Registers in bands make candidate groups;
within those, the collision-corrected Jaccard estimate goes before a comparison of full sets.
"""

from __future__ import annotations

from collections import OrderedDict
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_tables, rows_from, table, with_columns, written
from .graph import components

WORDS = 5
BANDS, ROWS = 52, 5  # a pair at 0.75 shares no band with a chance of 8e-7
REGISTERS = BANDS * ROWS
MANTISSA = 10
SHARE = (75, 100)
#: The estimate's standard deviation is 0.027 at the threshold for this many registers; pairs below
#: it by more than five of them aren't compared.
SLACK = 0.14
#: In a bucket, sets of different components must agree in so many of the low bytes of their first
#: registers before they make a pair: five standard deviations below what 0.75 gives.
QUICK, AGREE = 64, 31
#: Bits of the map of a set's shingles, which bounds what two sets can share.
BITS = 4096
#: Bits of the map of the keys of texts that are needed again: 2 MB.
KEY_BITS = 1 << 24
#: Before the last comparison, buckets are dealt into groups of about so many, so many times over,
#: and each group is compared with its smallest.
GROUP, TURNS = 8, 2
#: Word hashes that a task remembers.
REMEMBERED = 100_000

P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * P2
    x = (x ^ (x >> np.uint64(27))) * P3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = found
        return found


def shingles(text: str | None, hashes: dict[bytes, int], words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words; of all words if they are fewer."""
    own = (text or "").encode().lower().split()
    if not own:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own))
    n = min(words, len(own))
    out = np.full(len(own) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * P1 + codes[k : len(own) - n + 1 + k]
    return np.unique(mix(out))


def _orders() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket, the order in which it asks others; and each other's place in it."""
    random = np.random.default_rng(20240229)
    order = np.stack([random.permutation(REGISTERS) for _ in range(REGISTERS)])
    return order, np.argsort(order, axis=1)


ORDER, PLACE = _orders()


def registers(found: np.ndarray) -> np.ndarray:
    """The sketch of a set that isn't empty: a uint16 for each bucket."""
    wide = (found >> np.uint64(32)) * np.uint64(REGISTERS)
    bucket = (wide >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # hashes are sorted: the first of a bucket is its least
    rest = (wide[first] << np.uint64(32)) | (found[first] & np.uint64(0xFFFFFFFF))
    fraction, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint16)
    mantissa = ((fraction - 0.5) * (2 << MANTISSA)).clip(0, (1 << MANTISSA) - 1).astype(np.uint16)
    out = np.zeros(REGISTERS, np.uint16)
    filled = np.zeros(REGISTERS, bool)
    used = bucket[first]
    out[used] = zeros << np.uint16(MANTISSA) | mantissa
    filled[used] = True
    empty = np.flatnonzero(~filled)
    source = np.arange(REGISTERS)
    for ask in range(6):
        if not len(empty):
            break
        other = ORDER[empty, ask]
        good = filled[other]
        source[empty[good]] = other[good]
        empty = empty[~good]
    if len(empty):
        source[empty] = used[np.argmin(PLACE[np.ix_(empty, used)], axis=1)]
    return out[source]


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, for sets of n and m members, less the matches that
    chance gives."""
    ratio = n / m
    chance = 0.169919487159739 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


SKETCH = T.StructType([
    T.StructField("n_shingles", T.LongType()),
    T.StructField("set_key", T.BinaryType()),
    T.StructField("registers", T.BinaryType()),
    T.StructField("quick", T.ArrayType(T.LongType())),
])


def sketch_column(docs: DataFrame) -> DataFrame:
    """docs, but for the text, with n_shingles, set_key (a 128-bit digest of the set), registers, and quick (low bytes
    of the first registers, eight in a long); all but the first are null for documents without
    words."""

    def start():
        hashes = WordHashes()

        def step(rows):
            out: dict[str, list] = {name: [] for name in SKETCH.names}
            for text in rows["text"]:
                found = shingles(text, hashes)
                own = registers(found) if len(found) else None
                out["n_shingles"].append(len(found))
                out["set_key"].append(None if own is None else xxhash.xxh3_128_digest(found.tobytes()))
                out["registers"].append(None if own is None else own.tobytes())
                out["quick"].append(None if own is None else own[:QUICK].astype(np.uint8).view(np.int64).tolist())
            return out

        return step

    return with_columns(docs, ["text"], SKETCH, start, without=["text"])


def band_keys() -> Column:
    size = 2 * ROWS
    return F.array(*(F.xxhash64(F.lit(i), F.expr(f"substring(registers, {i * size + 1}, {size})")) for i in range(BANDS)))


def band_rows(sets: DataFrame) -> DataFrame:
    """(id, at, band) for each band of each set's registers; at is its number."""
    return sets.select("id", F.posexplode(band_keys()).alias("at", "band"))


def agreeing(a: str, b: str) -> Column:
    """In how many bytes two arrays of longs agree."""

    def differ(i: int) -> Column:
        z = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift)).bitwiseAND(F.lit(mask))
        return F.bit_count(z)

    return QUICK - reduce(lambda x, y: x + y, map(differ, range(QUICK // 8)))


def can_share(n: str, m: str, a: str, b: str) -> Column:
    """Whether maps of the shingles leave room for what sets of n and m members must share: no more
    than the bits that both have, and the members that found their bit taken. True without a map."""
    set_in = lambda bits: F.aggregate(F.col(bits), F.lit(0), lambda x, w: x + F.bit_count(w))
    both = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)), F.lit(0), lambda x, w: x + F.bit_count(w))
    most = both + F.least(F.col(n) - set_in(a), F.col(m) - set_in(b))
    return F.coalesce(most * sum(SHARE) >= (F.col(n) + F.col(m)) * SHARE[0], F.lit(True))


def comparable(n: str, m: str, common_a: str, common_b: str, a: str, b: str) -> Column:
    """Whether two sets' sizes, shingles that others have too, and first registers allow the
    similarity. Sets of n and m members must share (n + m) * 75 / 175."""
    sizes = F.least(n, m) * SHARE[1] >= F.greatest(n, m) * SHARE[0]
    enough = F.least(common_a, common_b) * sum(SHARE) >= (F.col(n) + F.col(m)) * SHARE[0]
    return sizes & enough & (agreeing(a, b) >= AGREE)


def unique_shingles(texts: DataFrame) -> DataFrame:
    """(id, unique): of texts (id, text), how many shingles no other of them has. Texts without such
    shingles are left out. Counted before the shuffle, so common shingles are no load."""

    def start():
        hashes = WordHashes()

        def step(rows):
            found = [shingles(t, hashes) for t in rows["text"]]
            ids = [np.full(len(f), key, np.int64) for key, f in zip(rows["id"], found, strict=True)]
            return {"id": np.concatenate(ids) if ids else [], "shingle": np.concatenate(found).view(np.int64) if found else []}

        return step

    each = rows_from(texts, ["id", "text"], T.StructType([T.StructField(c, T.LongType()) for c in ("id", "shingle")]), start)
    alone = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    return alone.groupBy("id").agg(F.count(F.lit(1)).alias("unique"))


def bit_maps(texts: DataFrame) -> DataFrame:
    """(id, bits): the map of each text's shingles as longs."""

    def start():
        hashes = WordHashes()

        def step(rows):
            out = []
            for text in rows["text"]:
                bits = np.zeros(BITS, np.uint8)
                bits[(shingles(text, hashes) & np.uint64(BITS - 1)).astype(np.int64)] = 1
                out.append(np.packbits(bits).view(np.int64).tolist())
            return {"bits": out}

        return step

    return with_columns(texts.select("id", "text"), ["text"], T.StructType([T.StructField("bits", T.ArrayType(T.LongType()))]), start, without=["text"])


def perhaps_in(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key (a long) wanted has, and some more: a map of KEY_BITS bits, however many keys there are,
    is broadcast. So a join with wanted shuffles few of the other rows."""
    place, page = F.pmod(F.col(key), F.lit(KEY_BITS)), 32_768  # bits in one of Spark's bitmaps
    spots = wanted.select(place.alias("place")).select(F.floor(F.col("place") / page).alias("page"), (F.col("place") % page).alias("spot"))
    pages = spots.groupBy("page").agg(F.bitmap_construct_agg("spot").alias("bits"))
    spot = place % page
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (spot % 8).cast("int")) == 1
    return rows.join(F.broadcast(pages), (F.floor(place / page) == F.col("page")) & is_set, "left_semi")


def labelled(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """rows with the component of their id."""
    return rows.join(grouped.toDF("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def open_rows(members: DataFrame, grouped: DataFrame, scratch: list[str]) -> DataFrame:
    """(id, band, at, component, members) of the bands whose sets are still in several components."""
    rows = labelled(members, grouped)
    bands = rows.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"))
    return rows.join(written(bands.where("low <> high").select("band", "members"), scratch), "band")


def likely(pairs: DataFrame, sets: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """The pairs (a, b) whose sizes allow the similarity and whose estimate isn't far below it."""
    part = sets.select("id", "n_shingles", "registers")
    both = pairs.join(part.toDF("a", "n", "ra"), "a").join(part.toDF("b", "m", "rb"), "b")
    both = both.where((F.least("n", "m") * share[1] >= F.greatest("n", "m") * share[0]))
    bar = share[0] / share[1] - SLACK

    def step(rows):
        if not rows["n"]:
            return {"estimate": []}
        a, b = (np.frombuffer(b"".join(rows[c]), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
        return {"estimate": estimate(a, b, np.array(rows["n"], float), np.array(rows["m"], float)).tolist()}

    judged = with_columns(both, ["ra", "rb", "n", "m"], T.StructType([T.StructField("estimate", T.DoubleType())]), lambda: step, without=["ra", "rb"])
    return judged.where(F.col("estimate") >= bar).select("a", "b")


def linked(pairs: DataFrame, texts: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as that; texts: (id, text), each id once."""

    def start():
        hashes, known = WordHashes(), OrderedDict()

        def of(key, text):
            if key not in known:
                known[key] = shingles(text, hashes)
                if len(known) > 64:
                    known.popitem(last=False)
            return known[key]

        def step(rows):
            a, b = [], []
            for x, y, s, t in zip(rows["a"], rows["b"], rows["ta"], rows["tb"], strict=True):
                u, v = of(x, s), of(y, t)
                common = len(np.intersect1d(u, v, assume_unique=True))
                if len(u) and share[1] * common >= share[0] * (len(u) + len(v) - common):
                    a.append(x)
                    b.append(y)
            return {"a": a, "b": b}

        return step

    both = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")
    return rows_from(both, ["a", "b", "ta", "tb"], T.StructType([T.StructField(c, T.LongType()) for c in "ab"]), start)


def last_pairs(rest: DataFrame, scratch: list[str]) -> DataFrame:
    """The pairs (a, b) of different components that share a bucket and whose sizes, common
    shingles, first registers and maps allow the similarity, each once.

    In each bucket, the sets of its largest component are met by the others only, never by one
    another: a large group that is joined already costs nothing but its outsiders."""
    columns = ["id", "component", "n_shingles", "common", "quick", "keys", "bits"]
    each = rest.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = written(each.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("largest")), scratch)
    rows = rest.select("band", "at", *columns).join(largest, "band").withColumn("main", F.col("largest") == F.col("component")).drop("largest")
    rows = written(rows, scratch)
    left = rows.where("NOT main").drop("main").toDF("band", "at", *(f"{c}_a" for c in columns))
    right = rows.drop("at").toDF("band", *(f"{c}_b" for c in columns), "main")
    earlier = F.exists(F.zip_with(F.slice("keys_a", F.lit(1), F.col("at")), F.slice("keys_b", F.lit(1), F.col("at")), lambda x, y: x == y), lambda x: x)
    near = comparable("n_shingles_a", "n_shingles_b", "common_a", "common_b", "quick_a", "quick_b") & can_share("n_shingles_a", "n_shingles_b", "bits_a", "bits_b")
    both = left.join(right, (left["band"] == right["band"]) & F.expr("component_a <> component_b AND (main OR id_a < id_b)") & near & ~earlier)
    return both.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs; other columns are ignored.

    Empty and null texts have no shingles and no links. Where rows repeat a doc_id with other texts,
    each returns the group of its own text; component_id is the smallest id of the group's rows.
    Rows without a doc_id aren't linked: component_id is null and kept true. Repeated rows each
    return. An empty table gives no rows.

    Documents with equal sets become one numbered class first, so copies are never compared. In each
    band, every class is compared with the first of its bucket; the links found give components.
    Buckets whose classes are still in several components are dealt into small groups, each with
    its own leader, and so joined further: groups of near copies grow together in this way with
    few comparisons for each member. What is left in several components is compared in pairs, if
    sizes, shingles that others have too, first registers and maps of shingles allow it. So each
    pair that shares a band is compared or already joined.

    All steps are stored; what only they need is deleted at the end.
    """
    scratch: list[str] = []
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    sketched = written(sketch_column(docs), scratch)
    named = sketched.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    sets = named.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), *(F.first(c).alias(c) for c in ("n_shingles", "registers", "quick")))
    sets = written(sets.withColumn("id", F.monotonically_increasing_id()), scratch)  # the numbers stay, once written
    bands = band_rows(sets)
    # What is joined is written first: Spark then can split a bucket with very many sets in the join.
    shared = bands.groupBy("band").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1")
    members = written(bands.join(written(shared.select("band", "leader"), scratch), "band"), scratch)

    # One row of each class with company, and its text.
    wanted = sets.join(members.select("id").distinct(), "id", "left_semi").select("id", "row.doc_id", "row.text_key")
    wanted = written(wanted, scratch)
    texts = perhaps_in(docs, wanted, "text_key").join(wanted, ["doc_id", "text_key"]).groupBy("id").agg(F.first("text").alias("text"))
    texts = written(texts, scratch)

    first = members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = written(linked(likely(first, sets), texts), scratch)
    members, grouped = members.select("id", "band", "at"), components(links, scratch)
    # The only sets that can still have links are those of open buckets, and only with one another.
    left_over = open_rows(members, grouped, scratch).select("id").distinct()
    left_over = written(texts.join(written(left_over, scratch), "id", "left_semi"), scratch)
    facts = sets.select("id", "n_shingles", "quick", F.transform(band_keys(), lambda k: F.pmod(k, F.lit(1 << 31)).cast("int")).alias("keys"))
    facts = facts.join(bit_maps(left_over), "id").join(unique_shingles(left_over), "id", "left")
    facts = facts.withColumn("common", F.col("n_shingles") - F.coalesce("unique", F.lit(0))).drop("unique")
    facts = written(facts.where(F.col("common") * SHARE[1] >= F.col("n_shingles") * SHARE[0]), scratch)
    for turn in range(1, TURNS + 1 if not facts.isEmpty() else 1):
        rest = open_rows(members, grouped, scratch).join(facts.drop("keys", "bits"), "id")
        group = F.pmod(F.xxhash64("id", F.lit(turn)), F.greatest(F.lit(1), F.floor(F.col("members") / GROUP).cast("int")))
        rest = written(rest.withColumn("part", group), scratch)
        leaders = rest.groupBy("band", "part").agg(F.min(F.struct("id", "component", "n_shingles", "common", "quick")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
        both = rest.join(written(leaders.select("band", "part", "lead.*").toDF("band", "part", "a", "ca", "m", "common_a", "qa"), scratch), ["band", "part"])
        found = both.where(F.col("ca") != F.col("component")).where(comparable("n_shingles", "m", "common", "common_a", "quick", "qa"))
        pairs = found.select("a", F.col("id").alias("b")).distinct()
        links = links.unionAll(written(linked(likely(pairs, sets), left_over), scratch))
        grouped = components(links, scratch)
    rest = written(open_rows(members, grouped, scratch).join(facts, "id"), scratch)
    pairs = last_pairs(rest, scratch)
    final = components(links.unionAll(linked(likely(pairs, sets), left_over)), scratch)

    classes = written(labelled(sets.select("id", "set_key", F.col("row.doc_id").alias("least")), final), scratch)
    several = written(classes.groupBy("component").agg(F.min("least").alias("component_id")), scratch)  # so the join can split a large group
    classes = classes.join(several, "component").select("set_key", "component_id")
    out = sketched.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    out = written(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
    drop_tables(docs.sparkSession, scratch)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id, and all rows without words;
    same columns.

    Rows are what is grouped, whatever their ids: of repeated rows one stays, a repeated id with
    another text counts as another document, and rows without an id are grouped like others and
    come last. Of several rows with the smallest id, one stays.
    """
    scratch: list[str] = []
    own = {c: f"own {c}" for c in docs.columns}
    rows = written(docs.withColumnsRenamed(own).withColumn("row", F.monotonically_increasing_id()), scratch)
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col("own text").alias("text")))
    groups = found.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "own doc_id"), "row")
    order = F.struct(F.col("own doc_id").isNull().alias("none"), F.col("own doc_id").alias("id"), F.col("row").alias("row"))
    first = groups.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    out = written(rows.join(first, "row", "left_semi").select(*(F.col(f"`{name}`").alias(c) for c, name in own.items())))
    drop_tables(docs.sparkSession, scratch)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def brute(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """(n_shingles, component_id) by comparing all pairs of real shingle sets: for tests."""
    sets = {}
    for key, text in texts.items():
        own = (text or "").encode().lower().split()
        sets[key] = {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()
    top = {key: key for key in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {key: (len(sets[key]), find(key)) for key in keys}


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * common >= 75 * (na.n + nb.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_of AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least_of LEFT JOIN n USING (doc_id)
"""

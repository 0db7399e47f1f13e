"""N-gram Jaccard join by a token-group matrix.

A document's tokens are its four-word shingles. Sets that may have links are put into groups of similar
ones; the matrix says which tokens each group's union has. A set is a query against the groups of
other components: its overlap with a group's union bounds its overlap with each member, and only groups
whose bound is high enough are opened and their members compared.

All bounds are exact: sets of n and m tokens are similar only if they share (n + m) * 85 / 185.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_tables, rows_from, table, with_columns, written
from .graph import components
from .near_dedup import WordHashes, shingles

WORDS = 4
SHARE = (85, 100)
#: Least hashes by which sets are put together at first.
KEYS = 8
#: How many times that is done, and members of the parts of all but the first.
TURNS, PART = 2, 8
#: Rows of up to four numbers that are broadcast at most; more are shuffled.
BROADCAST_ROWS = 1_000_000
#: A group has about so many members and tokens at most; a larger component is several groups.
MEMBERS, TOKENS = 64, 200_000

SKETCH = T.StructType([
    T.StructField("n_shingles", T.LongType()),
    T.StructField("set_key", T.BinaryType()),
    T.StructField("set_id", T.LongType()),
    T.StructField("sample", T.ArrayType(T.LongType())),
])


def sketch_column(docs: DataFrame) -> DataFrame:
    """docs, but for the text, with n_shingles, set_key (a 128-bit digest of the set), set_id (64 bits of
    it) and sample, the tokens in a quarter of the hashes' range; all but the first are null without words."""

    def start():
        hashes = WordHashes()

        def step(rows):
            out: dict[str, list] = {name: [] for name in SKETCH.names}
            for text in rows["text"]:
                found = shingles(text, hashes, WORDS)
                key = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                out["n_shingles"].append(len(found))
                out["set_key"].append(key)
                out["set_id"].append(key and int.from_bytes(key[:8], "little", signed=True))
                out["sample"].append(found[: np.searchsorted(found, np.uint64(1 << 62))].view(np.int64) if key else None)
            return out

        return step

    return with_columns(docs, ["text"], SKETCH, start, without=["text"])


def unique_in_sample(sketched: DataFrame) -> DataFrame:
    """(set_id, unique): how many tokens of a set's sample no other set has. Least and largest sets are
    taken before the shuffle, so copies and common tokens are no load."""
    each = sketched.select("set_id", F.explode("sample").alias("token"))
    alone = each.groupBy("token").agg(F.min("set_id").alias("set_id"), F.max("set_id").alias("last")).where("set_id = last")
    return alone.groupBy("set_id").agg(F.count(F.lit(1)).alias("unique"))


def token_rows(texts: DataFrame) -> DataFrame:
    """(id, token) of each text's set."""

    def start():
        hashes = WordHashes()

        def step(rows):
            found = [shingles(t, hashes, WORDS) for t in rows["text"]]
            ids = [np.full(len(f), key, np.int64) for key, f in zip(rows["id"], found, strict=True)]
            return {"id": np.concatenate(ids) if ids else [], "token": np.concatenate(found).view(np.int64) if found else []}

        return step

    return rows_from(texts, ["id", "text"], T.StructType([T.StructField(c, T.LongType()) for c in ("id", "token")]), start)


def enough(shared: Column, n: str, m: str) -> Column:
    """Whether sets of n and m tokens that share so many are similar, or could be."""
    return shared * sum(SHARE) >= (F.col(n) + F.col(m)) * SHARE[0]


def near_sizes(n: str, m: str) -> Column:
    return F.least(n, m) * SHARE[1] >= F.greatest(n, m) * SHARE[0]


def overlap(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


def common_tokens(rows: DataFrame, scratch: list[str]) -> DataFrame:
    """(id, common): of (id, token) rows, each set's tokens that others have too, the rarest first."""
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    each = rows.join(written(counts, scratch), "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("common"))
    return each.select("id", F.col("common.token").alias("common"))


def similar_pairs(pairs: DataFrame, sets: DataFrame, scratch: list[str]) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    own = sets.select("id", "n_shingles", "common")
    both = written(pairs.join(own.toDF("b", "m", "common_b"), "b"), scratch).join(own.toDF("a", "n", "common_a"), "a")
    near = near_sizes("n", "m") & enough(F.least(F.size("common_a"), F.size("common_b")), "n", "m")
    return both.where(near).where(enough(overlap("common_a", "common_b"), "n", "m")).select("a", "b")


def first_links(sets: DataFrame, scratch: list[str]) -> DataFrame:
    """Links (a, b) between sets with a least hash in common, of which one is compared with all others.

    What has the same least hash and is still in several components is dealt into small parts in
    further turns, each with a first of its own. So the members of a large group of near copies meet
    some dozens of others each, and grow together, however many they are."""
    hashed = lambda k: lambda t: F.xxhash64(t, F.lit(k))
    least = [F.xxhash64(F.lit(k), F.array_min(F.transform("common", hashed(k)))) for k in range(KEYS)]
    keyed = written(sets.select("id", F.explode(F.array(*least)).alias("key")), scratch)
    links, found = None, sets.select("id", F.col("id").alias("component"))
    for turn in range(TURNS):
        rows = written(keyed.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), scratch)
        several = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members")).where("low <> high")
        part = F.pmod(F.xxhash64("id", "key", F.lit(turn)), F.ceil(F.col("members") / PART)) if turn else F.lit(0)
        rows = written(rows.join(written(several.select("key", "members"), scratch), "key").withColumn("part", part), scratch)
        order = F.struct(F.xxhash64("id", "key", F.lit(-1 - turn)).alias("order"), "id", "component")
        leaders = written(rows.groupBy("key", "part").agg(F.min(order).alias("first")).select("key", "part", F.col("first.id").alias("a"), F.col("first.component").alias("of")), scratch)
        pairs = written(rows.join(leaders, ["key", "part"]).where(F.col("component") != F.col("of")).select("a", F.col("id").alias("b")).distinct(), scratch)
        more = written(similar_pairs(pairs, sets, scratch), scratch)
        links = more if links is None else links.unionAll(more)
        found = components(links, scratch).toDF("id", "component")
    return links


def placed_in_groups(sets: DataFrame, links: DataFrame, scratch: list[str]) -> DataFrame:
    """sets with component, grown (its members) and group: a component, or a part of a large one."""
    found = components(links, scratch).toDF("id", "component")
    each = written(sets.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), scratch)
    sizes = each.groupBy("component").agg(F.count(F.lit(1)).alias("grown"), F.sum(F.size("common")).alias("total"))
    parts = F.greatest(F.ceil(F.col("grown") / MEMBERS), F.ceil(F.col("total") / TOKENS))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    sizes = written(sizes.select("component", "grown", parts.cast("long").alias("parts")), scratch)
    return each.join(sizes, "component").withColumn("group", F.xxhash64("component", part)).drop("parts")


def candidates(placed: DataFrame, scratch: list[str]) -> DataFrame:
    """(id, group): sets, and groups of larger components one of whose members can be similar.

    Similar sets share one of their rarest tokens, as many as they can miss and one more. A token whose
    sets are all in one component asks for nothing. The matrix says for each such token and group
    which sizes its members have, and how much at most they have from there on.
    """
    least = F.ceil(F.col("n_shingles") * SHARE[0] / SHARE[1])
    left = F.size("common") - F.col("at")
    rare = placed.select("id", "component", "grown", "group", "n_shingles", "common", F.posexplode(F.slice("common", F.lit(1), (F.size("common") - least + 1).cast("int"))).alias("at", "token"))
    rare = rare.select("id", "component", "grown", "group", "n_shingles", "token", left.alias("left"))
    rare = written(rare, scratch)
    several = rare.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    rare = written(rare.join(written(several, scratch), "token"), scratch)
    matrix = rare.groupBy("token", "group").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"), F.max("left").alias("left"), F.first("component").alias("component"), F.first("grown").alias("grown"))
    matrix = written(matrix, scratch).toDF("token", "of", "least", "most", "left_of", "component_of", "grown_of")
    larger = F.struct("grown", "component") < F.struct("grown_of", "component_of")
    sizes = (F.col("most") * SHARE[1] >= F.col("n_shingles") * SHARE[0]) & (F.col("n_shingles") * SHARE[1] >= F.col("least") * SHARE[0])
    room = enough(F.least("left", "left_of"), "n_shingles", "least")
    found = rare.join(matrix, (rare["token"] == matrix["token"]) & larger & sizes & room)
    return found.select("id", F.col("of").alias("group")).distinct()


def last_links(placed: DataFrame, scratch: list[str]) -> DataFrame:
    """Links (a, b) between sets of different components, from the groups that are opened."""
    asked = written(candidates(placed, scratch), scratch)
    unions = placed.groupBy("group").agg(F.array_distinct(F.flatten(F.collect_list("common"))).alias("union"), F.min("n_shingles").alias("least"))
    own = placed.select("id", F.col("n_shingles").alias("n"), F.col("common").alias("common_a"))
    queries = written(asked.join(own, "id"), scratch).toDF("a", "group", "n", "common_a")
    opened = queries.join(written(unions, scratch), "group")
    opened = opened.where(enough(overlap("common_a", "union"), "n", "least")).select("a", "group", "n", "common_a")
    opened = written(opened, scratch)
    members = placed.select(F.col("group").alias("of"), F.col("id").alias("b"), F.col("n_shingles").alias("m"), F.col("common").alias("common_b"))
    near = near_sizes("n", "m") & enough(F.least(F.size("common_a"), F.size("common_b")), "n", "m")
    return opened.join(members, (F.col("group") == F.col("of")) & near & enough(overlap("common_a", "common_b"), "n", "m")).select("a", "b")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text); other columns are ignored.

    Empty and null texts have no shingles and no links. Where rows repeat a doc_id with other texts,
    each returns the group of its own text; component_id is the smallest id of the group's rows.
    Rows without a doc_id aren't linked: component_id is null. Repeated rows each return. An empty
    table gives no rows.

    Copies are one set. A set with too many tokens of its own can have no link: a quarter of all
    tokens shows that for most sets, all tokens of what is left for more. The rest are linked to the
    first of those with the same least hashes, which joins groups of near copies with few comparisons;
    then the matrix finds whatever links there are between components. Within one nothing is
    compared again. Tokens are 64-bit hashes. All steps are stored; what only they need is deleted.
    """
    scratch: list[str] = []
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    sketched = written(sketch_column(docs), scratch)
    named = sketched.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = named.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("set_id").alias("set_id"), F.first("n_shingles").alias("n_shingles"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), scratch)  # the numbers stay, once written
    may_miss = lambda n: F.col("n_shingles") * (SHARE[1] - SHARE[0]) >= F.coalesce(n, F.lit(0)) * SHARE[1]
    wanted = classes.join(written(unique_in_sample(named), scratch), "set_id", "left").where(may_miss(F.col("unique")))
    wanted = wanted.select("id", "n_shingles", "row.doc_id", "row.text_key")

    wanted = written(wanted, scratch)
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted  # else whole texts are shuffled
    texts = docs.join(few, ["doc_id", "text_key"]).select("id", "text").dropDuplicates(["id"])
    rows = written(token_rows(texts), scratch)
    sets = wanted.select("id", "n_shingles").join(common_tokens(rows, scratch), "id")
    sets = written(sets.where(may_miss(F.col("n_shingles") - F.size("common"))), scratch)
    links = written(first_links(sets, scratch), scratch)
    placed = written(placed_in_groups(sets, links, scratch), scratch)
    final = components(links.unionAll(last_links(placed, scratch)), scratch).toDF("id", "component")

    classes = written(classes.select("id", "set_key", F.col("row.doc_id").alias("least")).join(final, "id", "left").withColumn("component", F.coalesce("component", "id")), scratch)
    several = written(classes.groupBy("component").agg(F.min("least").alias("component_id")), scratch)  # so the join can split a large group
    classes = written(classes.join(several, "component").select("set_key", "component_id"), scratch)
    out = sketched.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    out = written(out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))
    drop_tables(docs.sparkSession, scratch)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


def brute(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """(n_shingles, component_id) by comparing all pairs of real shingle sets: for tests."""
    sets = {}
    for key, text in texts.items():
        own = (text or "").encode().lower().split()
        sets[key] = {tuple(own[i : i + WORDS]) for i in range(max(1, len(own) - WORDS + 1))} if own else set()
    links: dict[int, set[int]] = {key: {key} for key in texts}
    for a in texts:
        for b in texts:
            n = len(sets[a] & sets[b])
            if n and SHARE[1] * n >= SHARE[0] * len(sets[a] | sets[b]):
                links[a].add(b)

    def reach(key: int) -> set[int]:
        seen, now = {key}, {key}
        while now:
            now = reduce(set.union, (links[k] for k in now), set()) - seen
            seen |= now
        return seen

    return {key: (len(sets[key]), min(reach(key))) for key in texts}


SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + {WORDS - 1}), ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - {WORDS - 1}) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE {SHARE[1]} * common >= {SHARE[0]} * (na.n + nb.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)
"""

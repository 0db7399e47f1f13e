"""Benchmark decontamination by a generalised suffix automaton.

The words of all test items go into one automaton. A document's words are streamed through it; at
each word the automaton's state says the longest ending of what was read that occurs in an item.
Where that length reaches a window (13 words, or a whole shorter item), the window's words are hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import accumulate

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, drop_tables, table, text_of, with_columns, written

WINDOW = 13
SHARE = 20  # contaminated: hit words are at least one in so many
#: Words of items that one automaton holds. More items are taken in blocks of about so many, one after another.
BLOCK_WORDS = 200_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(SPAN)),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
])


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; letters, digits and all that isn't ASCII make words."""
    return WORD.findall((text or "").encode().lower())


class Automaton:
    """The suffix automaton of several word sequences, and what occurs at each of its states."""

    def __init__(self, items: Iterable[tuple[str | None, Sequence[bytes]]], window: int = WINDOW):
        self.window = window
        self.codes: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        self.names: list[str | None] = []
        short: list[tuple[int, int, int]] = []  # state, length, item
        for name, item in items:
            if not item:
                continue
            number, last = len(self.names), 0
            self.names.append(name)
            for word in item:
                last = self._extend(last, self.codes.setdefault(word, len(self.codes)), ends)
                ends[last].add(number)
            if len(item) < window:
                short.append((last, len(item), number))
        self._finish(ends, short)

    def _new(self, length: int, follow: dict[int, int], link: int, ends: list[set[int]]) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        ends.append(set())
        return len(self.next) - 1

    def _split(self, state: int, code: int, target: int, ends: list[set[int]]) -> int:
        """The state for the ending that `state` and `code` give, parted from a longer one."""
        copy = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target], ends)
        while state != -1 and self.next[state].get(code) == target:
            self.next[state][code] = copy
            state = self.link[state]
        self.link[target] = copy
        return copy

    def _extend(self, last: int, code: int, ends: list[set[int]]) -> int:
        target = self.next[last].get(code)
        if target is not None:  # an earlier item has this
            return target if self.length[target] == self.length[last] + 1 else self._split(last, code, target, ends)
        new = self._new(self.length[last] + 1, {}, 0, ends)
        state = last
        while state != -1 and code not in self.next[state]:
            self.next[state][code] = new
            state = self.link[state]
        if state != -1:
            target = self.next[state][code]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, code, target, ends)
        return new

    def _finish(self, ends: list[set[int]], short: list[tuple[int, int, int]]) -> None:
        """For each state: the shortest and the longest window that ends there, and the items of all."""
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        for state in order:
            if self.length[self.link[state]] >= self.window:  # shorter ones need no items
                ends[self.link[state]] |= ends[state]
        self.reach = [0] * len(self.next)  # of the longest short item that is an ending of all that the state stands for
        self.items: list[frozenset[int]] = [frozenset()] * len(self.next)
        own: dict[int, list[tuple[int, int]]] = {}
        for state, length, item in short:
            own.setdefault(state, []).append((length, item))
        at_window: dict[int, frozenset[int]] = {}
        for state in reversed(order):
            up = self.link[state]
            found, reach = self.items[up], self.reach[up]
            for length, item in own.get(state, ()):
                found, reach = found | {item}, max(reach, length)
            if self.length[up] < self.window <= self.length[state]:
                at_window[state] = frozenset(ends[state])
            self.items[state], self.reach[state] = found, reach
        # The state that holds the window's ending of what a state stands for.
        self.holds = [-1] * len(self.next)
        for state in reversed(order):
            self.holds[state] = state if state in at_window else self.holds[self.link[state]]
        self.at_window = at_window
        self.least = min([self.window if self.length and max(self.length) >= self.window else 1 << 30, *(n for _, n, _ in short)])

    def match(self, text: Sequence[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal spans of hit words (end exclusive), and the numbers of the items with windows there."""
        get = self.codes.get
        codes = np.fromiter((get(w, -1) for w in text), np.int64, len(text))
        spans: list[list[int]] = []
        found: set[int] = set()
        # Items hold none of the words that break these runs, and no window is shorter than `least`.
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= self.least:
                self._stream(codes[a:b].tolist(), a, spans, found)
        return [(a, b) for a, b in spans], found

    def _stream(self, codes: list[int], at: int, spans: list[list[int]], found: set[int]) -> None:
        follow, link, length, window = self.next, self.link, self.length, self.window
        state = size = 0
        for end, code in enumerate(codes, at + 1):
            while state and code not in follow[state]:
                state = link[state]
                size = length[state]
            state = follow[state].get(code, 0)
            size = size + 1 if state else 0
            # What was read stands for the state only from the length of its link on.
            hit = self.reach[link[state]] if state else 0
            if state:
                if self.reach[state] > hit and self.reach[state] <= size:
                    hit = self.reach[state]
                    found |= self.items[state]
                else:
                    found |= self.items[link[state]]
            if size >= window:
                hit = max(hit, window)
                found |= self.at_window[self.holds[state]]
            if hit:
                start = end - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, end])


def _pieces(items: DataFrame, window: int, piece_words: int) -> DataFrame:
    """(item_id, text, n): items of more than piece_words words cut into pieces that overlap by a window
    less one word, so each window is whole in one of them. Shorter items are one piece."""
    own = F.regexp_extract_all(ascii_lower(text_of()), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    each = items.select("item_id", own.alias("own")).where(F.size("own") > 0)
    count = F.greatest(F.lit(1), F.ceil((F.size("own") - (window - 1)) / piece_words)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice("own", k * piece_words + 1, F.lit(piece_words + window - 1)))
    return each.select("item_id", F.explode(cut).alias("own")).select("item_id", F.array_join("own", " ").alias("text"), F.size("own").alias("n"))


def _blocks(items: DataFrame, window: int, block_words: int, scratch: list[str]) -> list[DataFrame]:
    """Parts of the items, each of about block_words words, whatever one item's length is and however many
    items are equal: pieces are counted along, in each stored partition and over the partitions' sums."""
    pieces = _pieces(items, window, max(1, block_words // 10))
    total = pieces.agg(F.sum("n")).first()[0] or 0
    if total <= block_words:
        return [items]
    stored = written(pieces.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), scratch)
    sums = {r["part"]: r["n"] for r in stored.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one number a partition
    before = dict(zip(sorted(sums), accumulate([0, *(sums[p] for p in sorted(sums))])))
    start = F.try_element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("part"))
    along = F.sum("n").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    numbered = written(stored.withColumn("block", F.floor((start + F.coalesce(along, F.lit(0))) / block_words)), scratch)
    return [numbered.where(F.col("block") == k).select("item_id", "text") for k in range(-(-total // block_words))]


def _marked(docs: DataFrame, block: DataFrame, window: int) -> tuple[DataFrame, Broadcast]:
    """docs with what one block of items hits, and what was broadcast for it."""
    listed = [(r["item_id"], words(r["text"])) for r in block.toLocalIterator()]
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(listed, window))

    def start():
        automaton: Automaton = sent.value

        def step(rows):
            found: dict[str, list] = {name: [] for name in HITS.names}
            for text in rows["text"]:
                own = words(text)
                spans, numbers = automaton.match(own)
                found["n_words"].append(len(own))
                found["hit_spans"].append([{"start": a, "end": b} for a, b in spans])
                found["hit_items"].append(sorted({automaton.names[x] for x in numbers} - {None}))
            return found

        return step

    return with_columns(docs, ["text"], HITS, start), sent


def match_column(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, hit_spans (maximal, in words, end exclusive) and hit_items (ids as strings).

    Null and empty texts have no words. Items without words have no windows; equal items all count;
    an item without an id hits but isn't listed. An empty items table hits nothing. Columns of docs
    with these names are replaced; others, and repeated rows, stay.

    Documents are never shuffled where one automaton holds all items. Larger item tables are taken
    in blocks of about block_words, one after another: docs are numbered and stored, each block is
    streamed over them, and only its hits are stored and joined. Long items are cut, so what the driver
    builds and sends, and what a worker holds, is bounded by block_words however many or long the items
    are. The work is that of the blocks times the documents.
    """
    scratch: list[str] = []
    blocks = _blocks(items.select(F.col("item_id").cast("string").alias("item_id"), "text"), window, block_words, scratch)
    if len(blocks) == 1:
        return _marked(docs, blocks[0], window)[0]
    kept = [c for c in docs.columns if c.lower() not in HITS.names]
    numbered = written(docs.select(*(F.col(f"`{c}`").alias(f"own {c}") for c in kept), "text", F.monotonically_increasing_id().alias("row")))
    hits = []
    for block in blocks:
        marked, sent = _marked(numbered.select("row", "text"), block, window)
        hits.append(written(marked.where(F.size("hit_spans") > 0).select("row", "hit_spans", "hit_items")))
        sent.destroy()
    drop_tables(docs.sparkSession, scratch)
    every = reduce(DataFrame.unionAll, hits).groupBy("row").agg(F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.flatten(F.collect_list("hit_items")).alias("hit_items"))

    def step(rows):
        spans = [[{"start": a, "end": b} for a, b in joined((s["start"], s["end"]) for s in own or ())] for own in rows["hit_spans"]]
        return {"n_words": [len(words(t)) for t in rows["text"]], "hit_spans": spans, "hit_items": [sorted(set(own or ())) for own in rows["hit_items"]]}

    out = with_columns(numbered.join(every, "row", "left"), ["text", "hit_spans", "hit_items"], HITS, lambda: step)
    return out.select(*(F.col(f"`own {c}`").alias(c) for c in kept), *HITS.names)


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def hit_words() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(share: int = SHARE) -> Column:
    """Hit, and at least one word in `share` is."""
    return (hit_words() > 0) & (hit_words() * share >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with the columns of docs. Null and empty texts have no
    words and stay; repeated rows are judged alike; an empty table gives no rows."""
    own = {c: f"own {c}" if c.lower() in HITS.names else c for c in docs.columns}
    marked = match_column(docs.withColumnsRenamed(own), items)
    return marked.where(~contaminated()).select(*(F.col(f"`{name}`").alias(c) for c, name in own.items()))


def cut_spans(docs: DataFrame, items: DataFrame, longest: int = 50) -> DataFrame:
    """docs, with the words of hit spans of more than `longest` words, and the marks between them,
    cut from the text. A null text stays null."""

    def start():
        def cut(text, spans):
            if text is None or not spans:
                return text
            raw = text.encode()
            at = [m.span() for m in WORD.finditer(raw.lower())]
            keep, last = [], 0
            for s in spans:
                if s["end"] - s["start"] > longest:
                    keep.append(raw[last : at[s["start"]][0]])
                    last = at[s["end"] - 1][1]
            return b"".join([*keep, raw[last:]]).decode()

        return lambda rows: {"text": [cut(*x) for x in zip(rows["text"], rows["hit_spans"], strict=True)]}

    marked = match_column(docs, items)
    return with_columns(marked, ["text", "hit_spans"], T.StructType([T.StructField("text", T.StringType())]), start).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = match_column(docs, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def brute(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, list[str]]:
    """Words, hit words and item ids by comparing every window: for tests."""
    own = words(text)
    hit, names = set(), set()
    for name, item in items:
        other = words(item)
        n = min(window, len(other))
        parts = {tuple(other[i : i + n]) for i in range(len(other) - n + 1)} if n else set()
        for i in range(len(own) - n + 1 if n else 0):
            if tuple(own[i : i + n]) in parts:
                hit.update(range(i, i + n))
                names.add(name)
    return len(own), len(hit), sorted(names)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS part FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS part FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM item_windows) ON len(w) >= n)
), found AS (
  SELECT doc_id, n, i, item FROM doc_windows JOIN item_windows USING (n, part)
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

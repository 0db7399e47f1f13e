"""Byte-level BPE encoding and decoding by a segment tree.

A piece of text is a row of tokens, at first its bytes. A segment tree over the byte positions
holds, for each live position, the rank of the pair that begins there; every node keeps the least
(rank, position) below it, so the root is the leftmost pair of lowest rank. A merge changes three
leaves: the merged position's, its swallowed neighbour's and its left neighbour's.

Pieces of about one length have their trees side by side in one array: each step does one merge in
each of them. `merge` does it for a single piece, which may be long.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import kept, table, with_columns

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces, and words, whose ids a worker remembers; longer ones it doesn't.
PIECES, WORDS, LONG = 140_000, 100_000, 64
#: New words that are taken to pieces together.
RUN = 1 << 17
#: Nodes of the trees that are side by side; fewer pieces of one length than FEW are merged one by one.
NODES, FEW = 1 << 18, 32
NONE = 1 << 62
SHIFT, LOW = 32, 0xFFFFFFFF  # a tree's value is rank << SHIFT | position


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """The rank of the token that each pair of tokens makes, by first << SHIFT | second."""
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            first, second = ranks.get(token[:cut]), ranks.get(token[cut:])
            if first is not None and second is not None:
                out[first << SHIFT | second] = rank
    return out


def merge(piece: bytes, ranks: dict[bytes, int], pairs: dict[int, int]) -> list[int]:
    """The ids of one piece. Raises KeyError for a byte that the vocabulary lacks."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    leaves = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * leaves)
    tokens = [ranks[piece[i : i + 1]] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = pairs.get
    for i in range(n - 1):
        if (rank := get(tokens[i] << SHIFT | tokens[i + 1])) is not None:
            tree[leaves + i] = rank << SHIFT | i
    for node in range(leaves - 1, 0, -1):
        x, y = tree[2 * node], tree[2 * node + 1]
        tree[node] = x if x < y else y
    while (least := tree[1]) != NONE:
        at = least & LOW
        gone = after[at]
        token = tokens[at] = least >> SHIFT  # a pair's rank is the id of what it makes
        right = after[at] = after[gone]
        tree[leaves + gone] = tree[leaves + at] = NONE
        if right < n:
            before[right] = at
            if (rank := get(token << SHIFT | tokens[right])) is not None:
                tree[leaves + at] = rank << SHIFT | at
        left = before[at]
        a = b = (leaves + at) >> 1
        c = (leaves + gone) >> 1
        if left >= 0:
            rank = get(tokens[left] << SHIFT | token)
            tree[leaves + left] = NONE if rank is None else rank << SHIFT | left
            a = (leaves + left) >> 1
        while a:  # the three leaves' ways to the root, which soon are one
            x, y = tree[2 * a], tree[2 * a + 1]
            tree[a] = x if x < y else y
            if b != a:
                x, y = tree[2 * b], tree[2 * b + 1]
                tree[b] = x if x < y else y
            if c != b:
                x, y = tree[2 * c], tree[2 * c + 1]
                tree[c] = x if x < y else y
            a >>= 1
            b >>= 1
            c >>= 1
    out, at = [], 0
    while at < n:
        out.append(tokens[at])
        at = after[at]
    return out


class PairRanks:
    """Ranks of many pairs of tokens at once: a hash table, where a key is at its home or behind it,
    with no gap between."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pairs: dict[int, int]):
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs)) << SHIFT
        bits = max(4, (2 * len(pairs)).bit_length())
        self.down = np.uint64(64 - bits)
        home = self.home(keys)
        order = np.argsort(home, kind="stable")
        steps = np.arange(len(keys))
        slots = np.maximum.accumulate(home[order] - steps) + steps if len(keys) else steps
        # The last slot is empty, so that each search ends.
        size = max(1 << bits, int(slots[-1]) + 1 if len(keys) else 0) + 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int64)
        self.keys[slots], self.values[slots] = keys[order], values[order]

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * self.MIX >> self.down).view(np.int64)

    def __call__(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """rank << SHIFT for each pair, NONE for what isn't one. A token of -1 is in no pair."""
        keys = first << SHIFT | second
        slots = self.home(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NONE)
        rest = np.flatnonzero((found != keys) & (found != -1))
        while len(rest):
            slots[rest] += 1
            found = self.keys[slots[rest]]
            same = found == keys[rest]
            out[rest[same]] = self.values[slots[rest[same]]]
            rest = rest[~same & (found != -1)]
        return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, end to end."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def merge_side_by_side(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, leaves: int, byte_ids: np.ndarray, pairs: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each piece has, and the ids end to end. A piece is a run of the data, which has
    a tree of its own, with more leaves than it has bytes.

    Before a piece's tokens and behind them is a -1, so that a merge at an end is like any other.
    """
    count, width = len(sizes), leaves + 1
    places = np.arange(width)
    singles = byte_ids[data[ragged(starts, sizes)]]
    if (singles < 0).any():
        raise KeyError("a byte is not in the vocabulary")
    tokens = np.full((count, width), -1, np.int64)
    tokens[(places >= 1) & (places <= sizes[:, None])] = singles
    trees = np.empty((count, 2 * leaves), np.int64)
    at = np.arange(count * width).reshape(count, width)
    trees[:, leaves:] = pairs(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(count, leaves) | at[:, :-1]
    level = leaves
    while level > 1:
        np.minimum(trees[:, level : 2 * level : 2], trees[:, level + 1 : 2 * level : 2], out=trees[:, level // 2 : level])
        level //= 2
    tokens, trees = tokens.ravel(), trees.ravel()
    after, before = at.ravel() + 1, at.ravel() - 1
    rows = np.arange(count)
    while True:
        least = trees[rows * (2 * leaves) + 1]
        going = least < NONE
        rows, least = rows[going], least[going]
        if not len(rows):
            break
        at, token = least & LOW, least >> SHIFT  # a pair's rank is the id of what it makes
        gone, left = after[at], before[at]
        right = after[gone]
        tokens[at], tokens[gone] = token, -1
        after[at], before[right] = right, at
        starts = np.concatenate((left, at))
        values = pairs(tokens[starts], tokens[np.concatenate((at, right))]) | starts
        roots = np.tile(rows * (2 * leaves), 3)
        nodes = np.concatenate((starts, gone)) - np.tile(rows * width, 3) + leaves
        trees[roots + nodes] = np.concatenate((values, np.full(len(rows), NONE)))
        for _ in range(leaves.bit_length() - 1):  # the three leaves' ways to the root
            below = roots + (nodes & -2)
            nodes >>= 1
            trees[roots + nodes] = np.minimum(trees[below], trees[below + 1])
    live = tokens >= 0
    return live.reshape(count, width).sum(1), tokens[live]


def _characters(test: Callable[[str], bool], limit: int) -> str:
    return "".join(re.escape(chr(c)) for c in range(limit) if test(chr(c)))


def splitter(pattern: str, limit: int = 0x250) -> Callable[[str], list[str]]:
    """findall of the pattern. Where all characters are below the limit, a pattern of plain
    character sets does the same faster: made from the pattern by spelling out its classes."""
    import regex

    general = regex.compile(pattern).findall
    sets = {
        r"\p{L}": _characters(lambda c: unicodedata.category(c)[0] == "L", limit),
        r"\p{N}": _characters(lambda c: unicodedata.category(c)[0] == "N", limit),
        r"\s": _characters(lambda c: regex.match(r"\s", c) is not None, limit),
    }
    plain = pattern
    for inside in (r"[^\s\p{L}\p{N}]",):
        plain = plain.replace(inside, "[^" + "".join(sets.values()) + "]")
    plain = plain.replace(r"\S", "[^" + sets[r"\s"] + "]")
    for name, chars in sets.items():
        plain = plain.replace(name, "[" + chars + "]")
    known = re.compile(plain).findall
    other = re.compile(f"[^\\x00-{chr(limit - 1)}]").search
    return lambda text: general(text) if other(text) else known(text)


IDS = pa.list_(pa.int32())


def lists_of(counts: np.ndarray, ids: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), ids, type=IDS)


def put_together(lists: pa.Array, counts: np.ndarray) -> pa.Array:
    """Lists of which each is so many of the given ones, end to end."""
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
    return pa.ListArray.from_arrays(pa.array(ends[np.concatenate(([0], np.cumsum(counts)))], pa.int32()), lists.flatten(), type=IDS)


class Remembered:
    """Ids of strings, made on demand for many at once. Those that were asked for last are kept."""

    def __init__(self, make: Callable[[pa.Array], pa.Array], most: int):
        self.make, self.most, self.keys, self.ids = make, most, pa.array([], pa.string()), pa.array([], IDS)

    def __call__(self, keys: pa.Array) -> pa.Array:
        """The ids of keys, each of which is there once."""
        found = pc.index_in(keys, self.keys)
        new = keys.filter(found.is_null())
        places = pc.fill_null(found, -1).to_numpy().copy()
        places[places < 0] = len(self.ids) + np.arange(len(new))
        out = pa.concat_arrays([self.ids, self.make(new)]).take(pa.array(places))
        short = pc.less_equal(pc.binary_length(keys), LONG)
        others = np.ones(len(self.keys), bool)
        others[found.drop_null()] = False
        others = pa.array(others)
        self.keys = pa.concat_arrays([keys.filter(short)[: self.most], self.keys.filter(others)])
        self.ids = pa.concat_arrays([out.filter(short)[: self.most], self.ids.filter(others)])
        if len(self.keys) > self.most:  # a copy, so that nothing holds the rest
            first = pa.array(np.arange(self.most))
            self.keys, self.ids = self.keys.take(first), self.ids.take(first)
        return out


class Encoder:
    """Encodes texts; remembers the ids of the pieces and words it has met, up to a bound."""

    #: White space that stays a piece between two words with spaces before them.
    MARK = "\x0b"

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split, self.ranks, self.pairs = splitter(pattern), ranks, pair_table(ranks)
        self.pair_ranks = PairRanks(self.pairs)
        self.byte_ids = np.array([ranks.get(bytes([i]), -1) for i in range(256)])
        self.pieces = Remembered(self.of_pieces, PIECES)
        self.words = Remembered(self.of_words, WORDS)
        # White space before a space that isn't the last before a word: there, words can't be split on their own.
        self.tangled = re.compile(r"\s (?!\S)").search

    def of_pieces(self, pieces: pa.Array) -> pa.Array:
        """The ids of each piece: whole ones of the vocabulary, and merges for the rest."""
        if not len(pieces):
            return pa.array([], IDS)
        rank = np.fromiter((self.ranks.get(x, -1) for x in pieces.cast(pa.binary()).to_pylist()), np.int64, len(pieces))
        whole = rank >= 0
        order, counts, ids = [np.flatnonzero(whole)], [np.ones(whole.sum(), np.int64)], [rank[whole]]
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        data, starts, sizes = np.frombuffer(pieces.buffers()[2] or b"", np.uint8), ends[:-1], np.diff(ends)
        leaves = np.maximum(8, 2 ** np.frexp(sizes)[1].astype(np.int64))
        leaves[whole] = 0
        for n in np.unique(leaves[~whole]).tolist():
            group = np.flatnonzero(leaves == n)
            for some in np.array_split(group, -(-len(group) // max(1, NODES // (2 * n)))):
                if len(some) < FEW:
                    found = [merge(data[starts[i] : ends[i + 1]].tobytes(), self.ranks, self.pairs) for i in some]
                    made = np.fromiter(map(len, found), np.int64), np.fromiter(chain.from_iterable(found), np.int64)
                else:
                    made = merge_side_by_side(data, starts[some], sizes[some], n, self.byte_ids, self.pair_ranks)
                order.append(some)
                counts.append(made[0])
                ids.append(made[1])
        return lists_of(np.concatenate(counts), pa.array(np.concatenate(ids), pa.int32())).take(pa.array(np.argsort(np.concatenate(order))))

    def of_split(self, pieces: pa.Array, counts: np.ndarray) -> pa.Array:
        """The ids of strings that are so many pieces each."""
        each = pieces.dictionary_encode()
        return put_together(self.pieces(each.dictionary).take(each.indices), counts)

    def split_each(self, strings: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of strings end to end, and how many each has."""
        found = [self.split(x) for x in strings]
        return pa.array(list(chain.from_iterable(found)), pa.string()), np.fromiter(map(len, found), np.int64)

    def split_words(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The same for words with a space before them, that neither begin nor end in white space:
        split at once, with marks between them."""
        pieces = pa.array(self.split(" " + f"{self.MARK} ".join(words.to_pylist())), pa.string())
        marks = pc.equal(pieces, self.MARK)
        at = np.flatnonzero(marks)
        if len(at) != len(words) - 1:
            return self.split_each([" " + word for word in words.to_pylist()])
        return pieces.filter(pc.invert(marks)), np.diff(at, prepend=-1, append=len(pieces)) - 1

    def of_words(self, words: pa.Array) -> pa.Array:
        """The ids of each word with a space before it."""
        out = [pa.array([], IDS)]
        for start in range(0, len(words), RUN):
            run = words[start : start + RUN]
            alone = pc.or_(pc.not_equal(pc.utf8_trim_whitespace(run), run), pc.or_(pc.equal(run, ""), pc.match_substring(run, self.MARK)))
            other = pc.match_substring_regex(run, r"[^\x00-\x{24f}]")  # what the plain pattern doesn't know
            kind = np.where(alone, 2, np.where(other, 1, 0))
            order = [np.flatnonzero(kind == k) for k in range(3)]
            parts = [self.split_words(run.take(pa.array(x))) for x in order[:2] if len(x)]
            parts.append(self.split_each([" " + word for word in run.take(pa.array(order[2])).to_pylist()]))
            ids = self.of_split(pa.concat_arrays([x for x, _ in parts]), np.concatenate([n for _, n in parts]))
            out.append(ids.take(pa.array(np.argsort(np.concatenate(order)))))
        return pa.concat_arrays(out)

    def encode_all(self, texts: list[str]) -> pa.Array:
        """Ids of each text. A single space before a word always begins a piece, so words with the
        space before them are encoded each on its own, and each but once, unless white space is
        tangled: then the whole text is as a first word is, which has no space before it."""
        if not texts:
            return pa.array([], IDS)
        tangled = [self.tangled(x) is not None for x in texts]
        words = pc.split_pattern(pa.array(["" if odd else x for x, odd in zip(texts, tangled, strict=True)], pa.string()), " ")
        counts, words = pc.list_value_length(words).to_numpy(), words.flatten()
        first = np.zeros(len(words), bool)
        first[np.cumsum(counts) - counts] = True
        firsts = self.of_split(*self.split_each([x if odd else x.partition(" ")[0] for x, odd in zip(texts, tangled, strict=True)]))
        each = words.filter(pa.array(~first)).dictionary_encode()
        places = np.empty(len(words), np.int64)
        places[~first] = each.indices
        places[first] = len(each.dictionary) + np.arange(len(texts))
        return put_together(pa.concat_arrays([self.words(each.dictionary), firsts]).take(pa.array(places)), counts)

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text as int32."""
        return self.encode_all([text]).flatten().to_numpy()


def encoder_of(path: str, pattern: str) -> Encoder:
    """One for each Python worker, for all its tasks of a stage."""
    return kept(("encoder", path, pattern), lambda: Encoder(load_ranks(path), pattern))


def _tokens(path: str) -> pa.Array:
    tokens = {rank: token for token, rank in load_ranks(path).items()}
    return pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.binary())


def tokens_of(path: str) -> pa.Array:
    """Each token's bytes at the place of its id; for a worker's tasks of a stage."""
    return kept(("tokens", path), lambda: _tokens(path))


def joined(ids: pa.Array, tokens: pa.Array) -> pa.Array:
    """The bytes of each list of ids. The tokens of all lists are put end to end at once; a row is
    what lies between its first and its last."""
    flat = ids.flatten()
    if len(flat) and not 0 <= pc.min(flat).as_py() <= pc.max(flat).as_py() < len(tokens):
        raise KeyError("an id is not in the vocabulary")
    taken = tokens.take(flat)
    if taken.null_count:
        raise KeyError("an id is not in the vocabulary")
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))))
    places = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1) if len(taken) else np.zeros(1, np.int32)
    rows = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(places[ends].astype(np.int32)), taken.buffers()[2] or pa.py_buffer(b"")])
    return pc.if_else(ids.is_valid(), rows, pa.scalar(None, pa.binary()))


def id_lists(texts: list[str | None], encoder: Encoder) -> pa.Array:
    return encoder.encode_all([x or "" for x in texts])


def _vocabulary(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or default_path(), pattern or public_tokenizers.PATTERN


def encode_column(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with the ids of each text, without special tokens.

    Null and empty texts have no ids. Texts may be of any length: a piece of n bytes takes
    O(n log n). A column named like `out` is replaced; other columns and repeated rows stay. Every
    executor reads the vocabulary at `path`.
    """
    path, pattern = _vocabulary(path, pattern)

    def start():
        encoder = encoder_of(path, pattern)
        return lambda rows: {out: id_lists(rows[text], encoder)}

    return with_columns(df, [text], T.StructType([T.StructField(out, T.ArrayType(T.IntegerType()))]), start)


def decode_column(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the bytes of each row's ids. Null ids give null; unknown ids raise KeyError."""
    path = path or default_path()

    field = T.StructType([T.StructField(out, T.BinaryType())])
    return with_columns(df, [ids], field, lambda: lambda rows: {out: joined(rows[ids], tokens_of(path))}, lists=False)


DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text, encoded and decoded: both in one
    pass through Python, so that ids never go through the JVM.

    Null and empty texts have no ids, and the digests of nothing. Rows without an id and repeated rows
    each return; other columns are ignored, also those with the new names; an empty table gives no rows.
    """
    path, pattern = _vocabulary(path, pattern)
    sha = lambda values: [hashlib.sha256(x.as_buffer()).hexdigest() for x in values]

    def start():
        encoder, tokens = encoder_of(path, pattern), tokens_of(path)

        def step(rows):
            ids = id_lists(rows["text"], encoder)
            shown = pc.binary_join(ids.cast(pa.list_(pa.string())), " ")
            return {"n_tokens": pc.list_value_length(ids).cast(pa.int64()), "ids_sha256": sha(shown), "decoded_sha256": sha(joined(ids, tokens))}

        return step

    return with_columns(docs.select("doc_id", "text"), ["text"], DIGESTS, start, without=["text"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))



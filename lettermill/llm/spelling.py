"""Spelling variant grouping by wildcard groups, without pairs of words.

A word belongs to a group for each of its positions: what stands before and after it. Words of one
group differ by one replaced code point. A word's deletions, joined with the vocabulary, say which words
differ by one inserted code point. Groups keep their size and their top two words, so each member
learns how many near words it has there and which is the most frequent; a word's groups are then
put together. A group has no more words than there are letters, however large the vocabulary is.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, drop_tables, rows_from, table, text_of, written

LETTERS = "[A-Za-zÀ-ÿ]+"
ONE_IN = 199  # so many runs lose a code point
LEAST, OCCURS = 6, 5  # code points and occurrences of a word
TIMES = 5  # a form is so many times as frequent
#: Words up to this length are keys as they are; of longer ones, keys are numbers (below).
PLAIN = 64
MODULUS, BASE = (1 << 127) - 1, 0x5851F42D4C957F2D14057B7EF767814F


def noisy(doc_id: Column, run: Column) -> Column:
    """The run, or the run without one code point where the checksum says so."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(h, F.lit(ONE_IN)) == 0, cut).otherwise(run)


def occurrences(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts, counted in tasks before they are shuffled."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text_of(), F.lit(f"({LETTERS})"), F.lit(1))).alias("run"))
    # A deletion only makes runs shorter.
    runs = runs.where(F.length("run") >= LEAST).select(noisy(F.col("doc_id"), ascii_lower(F.col("run"))).alias("word"))
    counted = runs.where(F.length("word") >= LEAST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= OCCURS)


def keys_of(word: str) -> tuple[str, list[str], list[str]]:
    """The key of a word, those of its wildcard groups, and those of its distinct deletions.

    Work and keys of a long word grow with its length, not with the square: its keys are polynomial
    numbers of 127 bits of what stands before and after a position. Two different strings of n code
    points have one number with a chance of n / 2^127.
    """
    size = len(word)
    at = [i for i in range(size) if i + 1 == size or word[i] != word[i + 1]]  # equal neighbours give one deletion
    if size <= PLAIN:
        return word, [f"{word[:i]}*{word[i + 1 :]}" for i in range(size)], [word[:i] + word[i + 1 :] for i in at]
    before, powers = [0], [1]
    for c in word:
        before.append((before[-1] * BASE + ord(c)) % MODULUS)
        powers.append(powers[-1] * BASE % MODULUS)
    # What stands after i, as a number: the whole less what the first i + 1 code points make.
    after = [(before[size] - before[i + 1] * powers[size - i - 1]) % MODULUS for i in range(size)]
    groups = [f"{size}*{i}:{before[i]:x}:{after[i]:x}" for i in range(size)]
    if size == PLAIN + 1:  # its deletions are keys as they are
        return f"{size}:{before[size]:x}", groups, [word[:i] + word[i + 1 :] for i in at]
    return f"{size}:{before[size]:x}", groups, [f"{size - 1}:{(before[i] * powers[size - i - 1] + after[i]) % MODULUS:x}" for i in at]


KEY = T.StructType([T.StructField("key", T.StringType()), T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])


def _keys(words: DataFrame, which: int) -> DataFrame:
    """(key, id, n) of the words' own keys (0), wildcard groups (1) or deletions (2)."""

    def step(rows):
        out: dict[str, list] = {name: [] for name in KEY.names}
        for key, word, n in zip(rows["id"], rows["word"], rows["n"], strict=True):
            found = keys_of(word)[which]
            found = [found] if which == 0 else found
            out["key"] += found
            out["id"] += [key] * len(found)
            out["n"] += [n] * len(found)
        return out

    return rows_from(words, ["id", "word", "n"], KEY, lambda: step)


def _ranked(n: Column, key: Column) -> Column:
    """Least where a word is the most frequent, and then first in order."""
    return F.named_struct(F.lit("less"), -n, F.lit("id"), key)


def _top(members: Column) -> Column:
    """The first two of (n, id) members: the most frequent ones, and the lowest ids of equally frequent ones."""
    order = F.transform(members, lambda m: _ranked(m["n"], m["id"]))
    return F.slice(F.sort_array(order), 1, 2)


def _other(top: Column, own: Column) -> Column:
    """The first of two that isn't the word itself."""
    first, second = F.get(top, F.lit(0)), F.get(top, F.lit(1))
    return F.when(first["id"] != own, first).otherwise(second)


def replacements(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of each member of a wildcard group with company: how many others the group
    has, and the first of its top two that isn't the member. Groups have at most a word for each letter."""
    groups = _keys(words, 1).groupBy("key").agg(F.collect_list(F.struct("n", "id")).alias("members")).where(F.size("members") > 1)
    each = groups.select(F.size("members").alias("size"), _top(F.col("members")).alias("top"), F.explode("members.id").alias("id"))
    return each.select("id", (F.col("size") - 1).cast("long").alias("n_near"), _other(F.col("top"), F.col("id")).alias("best"))


def indels(words: DataFrame) -> DataFrame:
    """The same for words that are a deletion of others, and for those others: deletions grouped by what
    they give, joined with the vocabulary. Such a group has at most a word for each letter and place."""
    longer = _keys(words, 2).groupBy("key").agg(F.collect_list(F.struct("n", "id")).alias("members"))
    both = longer.join(_keys(words, 0), "key")
    one = lambda key, n, best: F.named_struct(F.lit("id"), key, F.lit("n_near"), n.cast("long"), F.lit("best"), best)
    short = _ranked(F.col("n"), F.col("id"))
    of_short = one(F.col("id"), F.size("members"), F.get(_top(F.col("members")), F.lit(0)))
    rows = F.concat(F.array(of_short), F.transform("members", lambda m: one(m["id"], F.lit(1), short)))
    return both.select(F.inline(rows))


def roots(forms: DataFrame, scratch: list[str]) -> DataFrame:
    """(id, root) of forms (id, form): the end of each chain. A form is several times as frequent as
    what it is of, so chains have no circles and few links; each round doubles what is followed."""
    now = written(forms.select("id", F.col("form").alias("root")), scratch)
    while True:
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            return now
        now = written(now.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root")), scratch)


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of docs (doc_id, text); other columns are ignored.

    Null and empty texts have no words; an empty table, or one without words, gives no rows. A null
    doc_id counts as empty text before the colon. Repeated rows each count. Of equally frequent near
    words the first in code-point order is the form. Long words are no special case (see keys_of).

    Words are numbered in code-point order once, so ties and rows need no texts. Nothing but whether
    a table is empty goes to the driver.
    """
    scratch: list[str] = []
    words = written(occurrences(docs).orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), scratch)
    near = replacements(words).unionAll(indels(words)).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    found = words.select("id", "n").join(near, "id", "left")
    own = -F.col("best.less")
    found = found.select("id", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(own >= TIMES * F.col("n"), c).alias(name) for name, c in (("form", F.col("best.id")), ("form_n", own))))
    found = written(found, scratch)
    ends = roots(found.where("form IS NOT NULL").select("id", "form"), scratch)
    named = words.select("id", "word")
    out = found.join(ends, "id", "left").join(named, "id")
    out = out.join(named.toDF("form", "form_word"), "form", "left").join(named.toDF("root", "root_word"), "root", "left")
    out = written(out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"))
    drop_tables(docs.sparkSession, scratch)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def brute(docs: Iterable[tuple[int | None, str | None]]) -> set[tuple]:
    """Rows by comparing all pairs of words: for tests."""
    import re

    count: Counter = Counter()
    for key, text in docs:
        for run in re.findall(LETTERS, text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % ONE_IN == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= LEAST and n >= OCCURS}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by_size: dict[int, list[str]] = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    form, n_near = {}, {}
    for w, n in words.items():
        others = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_size.get(size, ()) if near(w, v)]
        n_near[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= TIMES * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, n_near[w], form[w] and words[form[w]]) for w, n in words.items()}


def _crc_table() -> list[int]:
    """The usual table of the CRC-32 polynomial, from its rule."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


SQL = f"""
WITH RECURSIVE o AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '{LETTERS}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY ALL
), h AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [CAST(192 + (unicode(ch) >> 6) AS BIGINT), CAST(128 + (unicode(ch) & 63) AS BIGINT)] END))),
    lambda c, b: xor(c >> 8, list_extract({_crc_table()}::BIGINT[], xor(c & 255, b) + 1))), 4294967295) AS h FROM o WHERE length(run) >= {LEAST}
), w AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN h % {ONE_IN} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(times) >= {OCCURS}
), p AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM p a JOIN p b ON a.i = b.i AND a.word <> b.word AND substr(a.word, 1, a.i - 1) || '*' || substr(a.word, a.i + 1) = substr(b.word, 1, b.i - 1) || '*' || substr(b.word, b.i + 1)
  UNION SELECT a.word, w.word, w.n FROM p a JOIN w ON w.word = substr(a.word, 1, a.i - 1) || substr(a.word, a.i + 1)
  UNION SELECT w.word, a.word, a.n FROM p a JOIN w ON w.word = substr(a.word, 1, a.i - 1) || substr(a.word, a.i + 1)
), best AS (
  SELECT word, count(*) AS n_near, min({{'less': -other_n, 'other': other}}) AS b FROM pairs GROUP BY word
), f AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= {TIMES} * n THEN b.other END AS form, CASE WHEN -b.less >= {TIMES} * n THEN -b.less END AS form_n FROM w LEFT JOIN best USING (word)
), r AS (
  SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL
)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL) USING (word)
"""

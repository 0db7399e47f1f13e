"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans: the strict ones of the contract, and looser ones, if they pass the check of
their kind (a card's digits, a phone's length). Labelers (layout, gazetteers, context, surroundings,
variety) vote on each span. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is, also where one is mostly wrong. The posteriors train a linear span
classifier on features of the span and of what stands around it, which the votes are not among; it
alone decides on the spans that aren't strict. Strict spans always stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, written

KINDS = ("email", "ip", "card", "phone", "secret")
#: name: (kind, pattern, text that must occur). Quantifiers are possessive, and starts are tied to
#: the first place of a run or the last match's end, so that long runs take linear time; what is
#: matched is the same. The first four are the contract's; "card" also has its 14 to 19 digits.
PATTERNS = {
    "email": ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": ("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", None),
    "phone": ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "loose_phone": ("phone", r"(?<![0-9])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", None),
    "loose_card": ("card", r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])", None),
    "secret": ("secret", r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])", None),
}
#: What every match of the patterns for cards and of the looser ones for phones has in it: ten digits.
MANY = r"[0-9](?:[^0-9A-Za-z]{0,2}[0-9]){9}"
STRICT = ("email", "ip", "card", "phone")
#: Gazetteers: fixed values.
TOP_DOMAINS = "com org net edu gov int info biz io co de fr es it nl uk eu us ca ch at be pl ru cn jp in br mx au".split()
CARD_STARTS = ("34", "36", "37", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "64", "65")
CUES = {
    "email": "mail|contact|write|reply|from|to",
    "ip": r"\bip\b|address|host|server|client|addr",
    "card": "card|visa|master|amex|account|pay|number",
    "phone": "phone|tel|call|mobile|fax|dial|contact|number",
    "secret": "token|key|secret|passw|auth|api",
}
AGAINST = r"version|isbn|issn|doi|release|build|commit|sha|md5|order|invoice|section"
LABELERS = ("layout", "gazetteer", "context", "surroundings", "variety")
ANCHOR = "context"
#: What the classifier sees of a span, each as a small number; and how many values each has.
FEATURES = {"length": 6, "digits": 4, "marks": 4, "variety": 5, "first": 5, "before": 6, "after": 6, "cue": 3}
BLOCK = 256  # items that a scan takes at once
CHUNK = 1024  # code points
ACCEPT = 0.7


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once, however often body uses it and in whatever loop."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(items: Column, zero: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The second of what step(state, item) gives, the first being the next state, for each item in
    turn, as an array of type `out`. Items are taken in blocks, and so results are copied at most
    BLOCK times: a single aggregate would copy all that it has for each item."""

    def inner(state: Column, block: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            after, result = step(acc["state"], x)
            return F.struct(after.alias("state"), F.concat(acc["out"], F.array(result)).alias("out"))

        return F.aggregate(block, F.struct(state.alias("state"), F.array().cast(f"array<{out}>").alias("out")), one)

    def whole(array: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / BLOCK).cast("int")), lambda b: F.slice(array, b * BLOCK + 1, F.lit(BLOCK)))
        begin = F.struct(zero.alias("state"), F.array().cast(f"array<array<{out}>>").alias("outs"))
        every = F.aggregate(
            blocks, begin, lambda acc, block: _let(inner(acc["state"], block), lambda done: F.struct(done["state"].alias("state"), F.concat(acc["outs"], F.array(done["out"])).alias("outs")))
        )
        return F.when(F.size(array) > 0, F.flatten(every["outs"])).otherwise(F.array().cast(f"array<{out}>"))

    return _let(items, whole)


def _starts(steps: Column) -> Column:
    """The sum of the steps before each."""
    return _scan(steps, F.lit(0), "int", lambda total, x: (total + x, total))


def _located(docs: DataFrame) -> DataFrame:
    """docs with an array of (start, end, match, before, after) for each pattern, named by it.

    Splitting at the pattern gives what lies between the matches, and so their places.
    """
    text = text_of()
    gates = {name: F.contains(text, F.lit(must)) if must else F.lit(True) for name, (_, _, must) in PATTERNS.items()}
    out = docs.withColumn("_digits", text.rlike("[0-9]")).withColumn("_many", F.col("_digits") & text.rlike(MANY))
    none = F.array().cast("array<string>")
    has = {"email": F.lit(True)} | {name: F.col("_many") for name in ("card", "loose_phone", "loose_card")}
    out = out.withColumns({
        f"_m_{name}": F.when(gates[name] & has.get(name, F.col("_digits")), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
        for name, (_, pattern, _) in PATTERNS.items()
    })
    out = out.withColumns({f"_p_{name}": F.when(F.size(f"_m_{name}") > 0, F.split(text, pattern, -1)) for name, (_, pattern, _) in PATTERNS.items()})
    out = out.withColumns({f"_l_{name}": F.zip_with(F.slice(f"_p_{name}", 1, F.size(f"_m_{name}")), f"_m_{name}", lambda p, m: F.length(p) + F.length(m)) for name in PATTERNS})
    out = out.withColumns({f"_s_{name}": F.when(F.size(f"_m_{name}") > 0, _starts(F.col(f"_l_{name}"))) for name in PATTERNS})

    def spans(name: str) -> Column:
        match, piece, start = (F.col(f"_{c}_{name}") for c in "mps")

        def one(i: Column) -> Column:
            before, found = F.get(piece, i), F.get(match, i)
            begin = F.get(start, i) + F.length(before)
            return F.struct(begin.alias("start"), (begin + F.length(found)).alias("end"), found.alias("match"), F.lower(F.right(before, F.lit(24))).alias("before"), F.left(F.get(piece, i + 1), F.lit(1)).alias("after"))

        empty = F.expr("cast(array() as array<struct<start:int,end:int,match:string,before:string,after:string>>)")
        return F.when(F.size(match) > 0, F.transform(F.sequence(F.lit(0), F.size(match) - 1), one)).otherwise(empty)

    out = out.withColumns({f"_f_{name}": spans(name) for name in PATTERNS})
    return out.select(*docs.columns, *(f"_f_{name}" for name in PATTERNS))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    digits = _digits(match)
    length = F.length(digits)

    def value(i: Column) -> Column:
        d = F.ascii(F.substring(digits, length - i + 1, F.lit(1))) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), length), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def small_parts(match: Column) -> Column:
    """Whether all numbers between dots are at most 255."""

    def small(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+(?=.)", "")
        return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(999)) <= 255)

    return F.forall(F.split(match, r"\."), small)


def valid(name: str, match: Column) -> Column:
    """The checks of the contract for a strict pattern; for others, that of their form."""
    count = F.length(_digits(match))
    if name == "email":
        return F.lit(True)
    if name == "ip":
        return small_parts(match)
    if name in ("card", "loose_card"):
        return luhn(match)
    if name in ("phone", "loose_phone"):
        return (count >= 10) & (count <= 15)
    return match.rlike("[0-9]") & match.rlike("[a-f]")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0)


def _votes(name: str, s: Column) -> dict[str, Column]:
    kind, match, before = PATTERNS[name][0], s["match"], s["before"]
    digits = _digits(match)
    gazetteer = {
        "email": _vote(F.lower(F.regexp_extract(match, r"([^.]*)$", 1)).isin(TOP_DOMAINS), F.regexp_extract(match, r"([^.]*)$", 1).rlike("[0-9]")),
        "ip": _vote(~match.rlike(r"^(?:0|127|255)\."), match.rlike(r"^0\.")),
        "card": _vote(reduce(lambda a, b: a | b, (F.startswith(digits, F.lit(x)) for x in CARD_STARTS)), F.startswith(digits, F.lit("0"))),
        "phone": _vote(match.rlike(r"^(?:\+[1-9]|\()"), F.startswith(digits, F.lit("00"))),
        "secret": _vote(F.length(match).isin(32, 40, 64), F.lit(False)),
    }[kind]
    variety = F.size(F.array_distinct(F.split(F.regexp_replace(match, r"[^0-9A-Za-z]", ""), "")))
    letters = F.length(F.regexp_replace(match, "[^a-f]", "")) / F.length(match)
    layout = {
        "email": _vote(match.rlike(r"^[A-Za-z0-9](?!.*\.\.)[^@]{0,63}@"), match.rlike(r"\.\.|\.@")),
        "ip": _vote(~match.rlike(r"(?:^|\.)0[0-9]"), match.rlike(r"(?:^|\.)0[0-9]")),
        "card": _vote(match.rlike(r"^(?:[0-9]+|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{4,5})$"), match.rlike(r"\x20.*-|-.*\x20")),
        "phone": _vote(match.rlike(r"^(?:\+[0-9]{1,3})?[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]?[0-9]{2,4}){2,4}$"), match.rlike(r"[\x20.-]{2}|\.[0-9]{1,2}\.")),
        "secret": _vote((letters >= 0.15) & (letters <= 0.65), (letters < 0.08) | (letters > 0.8)),
    }[kind]
    return {
        "layout": layout,
        "gazetteer": gazetteer,
        "context": _vote(before.rlike(CUES[kind]) & ~before.rlike(AGAINST), before.rlike(AGAINST)),
        "surroundings": _vote(~before.rlike(r"[0-9a-z_/=-]$") & ~s["after"].rlike("[0-9A-Za-z_]"), before.rlike(r"[0-9]$") | s["after"].rlike("[0-9A-Za-z]")),
        "variety": _vote(variety >= 4, variety <= 2),
    }


def _steps(value: Column, steps: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, ((value > F.lit(x)).cast("int") for x in steps))


def _kind_of(char: Column) -> Column:
    """0 nothing, 1 space, 2 letter, 3 digit, 4 a quote or bracket, 5 else."""
    return F.when(char == "", 0).when(char.rlike(r"\s"), 1).when(char.rlike("[0-9]"), 3).when(char.rlike(r"\w"), 2).when(char.rlike(r"[\"'<>(){}\[\]]"), 4).otherwise(5)


def _seen(name: str, s: Column) -> dict[str, Column]:
    """The classifier's features of a span."""
    match, before, kind = s["match"], s["before"], PATTERNS[name][0]
    length, plain = F.length(match), F.regexp_replace(match, r"[^0-9A-Za-z]", "")
    return {
        "length": _steps(length, (11, 14, 16, 19, 31)),
        "digits": _steps(F.length(_digits(match)) / length, (0.1, 0.5, 0.8)),
        "marks": _steps(length - F.length(plain), (0, 2, 4)),
        "variety": _steps(F.size(F.array_distinct(F.split(plain, ""))), (2, 4, 7, 12)),
        "first": F.when(F.left(match, F.lit(1)) == "+", 0).when(F.left(match, F.lit(1)) == "(", 1).when(F.left(match, F.lit(1)) == "0", 2).when(F.left(match, F.lit(1)).rlike("[0-9]"), 3).otherwise(4),
        "before": _kind_of(F.right(before, F.lit(1))),
        "after": _kind_of(s["after"]),
        "cue": F.when(before.rlike(AGAINST), 2).when(before.rlike(CUES[kind]), 1).otherwise(0),
    }


def candidates(docs: DataFrame) -> DataFrame:
    """docs with `_spans`: kind, start, end, strict, votes, seen (features in one number) of every
    span that a pattern proposes."""
    found = _located(docs)

    def judged(name: str) -> Column:
        def one(s: Column) -> Column:
            votes, seen = _votes(name, s), _seen(name, s)
            strict = F.lit(name in STRICT)
            code = reduce(lambda a, f: a * FEATURES[f] + seen[f], FEATURES, F.lit(0))
            return F.struct(
                s["start"].alias("start"), F.lit(KINDS.index(PATTERNS[name][0])).alias("kind"), s["end"].alias("end"),
                strict.alias("strict"), F.struct(*(votes[v].alias(v) for v in LABELERS)).alias("votes"), code.cast("int").alias("seen"),
            )

        return F.transform(F.filter(f"_f_{name}", lambda s: valid(name, s["match"])), one)

    return found.select(*docs.columns, F.concat(*(judged(name) for name in PATTERNS)).alias("_spans"))


Pattern = tuple[int, tuple[int, ...]]  # kind, votes


def reliabilities(counts: dict[Pattern, int], rounds: int = 40) -> tuple[list[float], dict[int, float], dict[Pattern, float]]:
    """Each labeler's chance of a right vote, each kind's share of real spans, and the posterior of
    each vote pattern. Votes of 0 say nothing. One labeler, the anchor, is taken to be right more often
    than wrong, which says what "real" means; the others may turn out to be as wrong as they are."""
    right = [0.8] * len(LABELERS)
    share = {kind: 0.5 for kind, _ in counts}
    after: dict[Pattern, float] = {}
    for _ in range(rounds):
        for kind, votes in counts:
            log = math.log(share[kind] / (1 - share[kind])) + sum(v * math.log(p / (1 - p)) for v, p in zip(votes, right, strict=True))
            after[kind, votes] = 1 / (1 + math.exp(-max(-50.0, min(50.0, log))))
        for j in range(len(LABELERS)):
            good = sum(n * (after[p] if p[1][j] > 0 else 1 - after[p]) for p, n in counts.items() if p[1][j])
            cast = sum(n for p, n in counts.items() if p[1][j])
            least = 0.55 if LABELERS[j] == ANCHOR else 0.02
            right[j] = min(0.98, max(least, (good + 8) / (cast + 10)))
        for kind in share:
            n = sum(c for p, c in counts.items() if p[0] == kind)
            share[kind] = min(0.98, max(0.02, (sum(c * after[p] for p, c in counts.items() if p[0] == kind) + 1) / (n + 2)))
    return right, share, after


OFFSETS = np.cumsum([0, *FEATURES.values()])
WIDTH = 1 + len(KINDS) + len(KINDS) * int(OFFSETS[-1])  # bias, kinds, and each feature's values by kind


def places(kind: int, seen: int) -> list[int]:
    """Which weights a span of this kind and these features has."""
    values = []
    for size in reversed(FEATURES.values()):
        seen, value = divmod(seen, size)
        values.append(value)
    first = 1 + len(KINDS) + kind * int(OFFSETS[-1])
    return [0, 1 + kind, *(first + int(at) + v for at, v in zip(OFFSETS, reversed(values), strict=False))]


def train(rows: Sequence[tuple[int, int, float, int]], rounds: int = 400, hold: float = 0.002) -> np.ndarray:
    """Logistic regression of (kind, features, posterior, count); a row's part grows with the
    logarithm of its count."""
    if not rows:
        return np.zeros(WIDTH)
    at = np.array([places(kind, seen) for kind, seen, _, _ in rows])
    goal = np.array([y for _, _, y, _ in rows])
    part = 1 + np.log([n for *_, n in rows])
    weights = np.zeros(WIDTH)
    for _ in range(rounds):
        miss = part / part.sum() * (1 / (1 + np.exp(-weights[at].sum(axis=1).clip(-50, 50))) - goal)
        weights -= 1.5 * (np.bincount(at.ravel(), np.repeat(miss, at.shape[1]), WIDTH) + hold * weights)
    return weights


def score(span: Column, weights: np.ndarray) -> Column:
    """The classifier's chance that a span is real."""
    z = F.get(F.array(*(F.lit(float(weights[0] + weights[1 + k])) for k in range(len(KINDS)))), span["kind"])
    below = int(np.prod(list(FEATURES.values())))
    for (name, size), at in zip(FEATURES.items(), OFFSETS, strict=False):
        below //= size
        value = F.floor(span["seen"] / below).cast("int") % size
        table_of = F.array(*(F.lit(float(weights[1 + len(KINDS) + k * int(OFFSETS[-1]) + int(at) + v])) for k in range(len(KINDS)) for v in range(size)))
        z = z + F.get(table_of, span["kind"] * size + value)
    return 1 / (1 + F.exp(-z))


def fit(proposed: DataFrame) -> np.ndarray:
    """The classifier's weights from the votes on all spans. What goes to the driver is a row for
    each vote pattern and each pattern with features: their number is bounded by the values that
    they have, whatever the data."""
    spans = proposed.where(F.size("_spans") > 0).select(F.explode("_spans").alias("s"))
    each = spans.groupBy("s.kind", "s.seen", *(F.col(f"s.votes.{v}").alias(v) for v in LABELERS)).count().collect()
    counts: dict[Pattern, int] = {}
    for r in each:
        key = r["kind"], tuple(r[v] for v in LABELERS)
        counts[key] = counts.get(key, 0) + r["count"]
    after = reliabilities(counts)[2]
    return train([(r["kind"], r["seen"], after[r["kind"], tuple(r[v] for v in LABELERS)], r["count"]) for r in sorted(each)])


PLAIN = "struct<start:int,kind:int,end:int>"


def decide(proposed: DataFrame, weights: np.ndarray, accept: float = ACCEPT) -> DataFrame:
    """`_spans` becomes `_base` and `_all`: arrays of (start, kind, end), sorted. Of the spans that
    aren't strict, those stay that the classifier accepts and that overlap no strict one and no
    accepted one before them."""
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    marked = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["strict"].alias("strict"))
    base = F.array_sort(F.transform(F.filter("_spans", lambda s: s["strict"]), plain))
    likely = F.filter("_spans", lambda s: s["strict"] | (score(s, weights) >= accept))
    none = F.lit((1 << 31) - 1)
    # Backwards: where the next strict span begins. Forwards: where those before end.
    ahead = _scan(F.reverse(F.array_sort(F.transform(likely, marked))), none, "struct<start:int,kind:int,end:int,strict:boolean,next:int>", lambda next, s: (
        F.when(s["strict"], s["start"]).otherwise(next),
        F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["strict"].alias("strict"), next.alias("next")),
    ))

    def forward(ends: Column, s: Column) -> tuple[Column, Column]:
        good = s["strict"] | ((s["start"] >= ends) & (s["end"] <= s["next"]))
        return F.when(good, F.greatest(ends, s["end"])).otherwise(ends), F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.when(good, s["end"]).otherwise(-1).alias("end"))

    free = F.filter(_scan(F.reverse(ahead), F.lit(0), PLAIN, forward), lambda s: s["end"] >= 0)
    some = F.exists("_spans", lambda s: ~s["strict"])
    out = proposed.withColumn("_base", base)
    return out.withColumn("_all", F.when(some, F.array_sort(F.array_distinct(free))).otherwise(F.col("_base"))).drop("_spans")


def shown(spans: str) -> Column:
    """kind:start:end of each, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each strict kind, base_sha256 and spans of each row's text.

    Places are code points, ends exclusive. Null and empty texts have no spans. Rows without an id
    and repeated rows each return; other columns are ignored; an empty table gives no rows.

    Proposed spans, without texts, are stored in the shared folder, so texts are searched once.
    Nothing is shuffled but counts of patterns. Work grows with the length of a text and the number
    of its spans, not with their square.
    """
    proposed = written(candidates(docs.select("doc_id", "text")).drop("text"))
    done = decide(proposed, fit(proposed))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return done.select("doc_id", *map(count, STRICT), F.sha2(shown("_base"), 256).alias("base_sha256"), shown("_all").alias("spans"))


GAP = "struct<from:int,to:int,mark:int>"


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets, and n_chars, where
    there is one, set to the new length. Spans that overlap are replaced as one, by the first's
    kind. Null texts stay null; all rows and columns stay."""
    own = {c: c if c in ("text", "n_chars") else f"own {c}" for c in docs.columns}
    stored = written(candidates(docs.withColumnsRenamed(own)))
    done = decide(stored, fit(stored.select("_spans")))
    gaps = _scan(F.col("_all"), F.lit(0), GAP, lambda end, s: (
        F.greatest(end, s["end"]),
        F.struct(end.alias("from"), s["start"].alias("to"), F.when((s["start"] >= end), s["kind"]).otherwise(-1).alias("mark")),
    ))
    last = F.struct(F.array_max(F.transform("_all", lambda s: s["end"])).alias("from"), F.length("text").alias("to"), F.lit(-1).alias("mark"))
    marks = F.array(*(F.lit(f"<{kind.upper()}>") for kind in KINDS))

    def pieces(chunks: Column) -> Column:
        def piece(g: Column) -> Column:
            first = F.floor(g["from"] / CHUNK).cast("int")
            joined = F.array_join(F.slice(chunks, first + 1, F.floor(g["to"] / CHUNK).cast("int") - first + 1), "")
            part = F.when(g["to"] > g["from"], F.substring(joined, g["from"] % CHUNK + 1, g["to"] - g["from"])).otherwise("")
            return F.concat(part, F.coalesce(F.get(marks, g["mark"]), F.lit("")))

        return F.array_join(F.transform(F.concat(gaps, F.array(last)), piece), "")

    cut = F.size("_all") > 0
    text = F.when(cut, _let(F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % CHUNK), F.lit(0)), pieces)).otherwise(F.col("text"))
    parted = done.withColumn("new text", text)
    columns = {"text": F.col("`new text`"), "n_chars": F.when(cut, F.length("new text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return parted.select(*((columns[c] if c in columns else F.col(f"`{name}`")).alias(c) for c, name in own.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


def brute(text: str | None) -> list[tuple[int, int, int]]:
    """The strict spans (start, kind, end) by the contract's own patterns: for tests."""
    import re

    text = text or ""
    out = []
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c.isdigit()]
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            twice = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
            if kind == 2 and not (14 <= len(digits) <= 19 and sum(twice) % 10 == 0):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)

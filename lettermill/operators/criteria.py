"""Search criteria, compiled to a Spark column.

Criteria are lists as mail searches know them: keys without an argument ("UNSEEN"), keys with
arguments (["FROM", "ann"]), negated keys ("!SEEN"), NOT, OR and nested lists. Flat lists like
["FROM", "ann", "UNSEEN"] are read from left to right. All parts of a list must hold; an empty
list holds always. Substring tests disregard case.
"""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import contains_text, no_array

SEEN, ANSWERED, FLAGGED, DELETED, DRAFT, RECENT = ("\\" + name for name in ("Seen", "Answered", "Flagged", "Deleted", "Draft", "Recent"))
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


class CriteriaError(ValueError):
    """A key that doesn't exist, lacks an argument, or has one that can't be read."""


def flag(name: str) -> Column:
    return F.array_contains(no_array("flags"), F.lit(name))


def any_contains(column: str, part: str) -> Column:
    return F.exists(no_array(column), lambda x: contains_text(x, part))


def read_date(value: Any) -> date:
    """A date, a datetime, `1-Jan-2024` or `2024-01-01`."""
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    parts = str(value).split("-")
    if len(parts) == 3 and parts[1].capitalize() in MONTHS:
        return date(int(parts[2]), MONTHS.index(parts[1].capitalize()) + 1, int(parts[0]))
    return date.fromisoformat(str(value))


def _since(column: str, value: Any) -> Column:
    return F.col(column) >= F.lit(read_date(value)).cast("timestamp_ntz")


def _before(column: str, value: Any) -> Column:
    return F.col(column) < F.lit(read_date(value)).cast("timestamp_ntz")


def _on(column: str, value: Any) -> Column:
    day = F.lit(read_date(value))
    return (F.col(column) >= day.cast("timestamp_ntz")) & (F.col(column) < F.date_add(day, 1).cast("timestamp_ntz"))


def _uids(value: Any, highest: Column | None = None) -> Column:
    """Numbers and ranges: 7, "3:9,12", "5:*", "*", or a list of such. `*` is the highest uid, so
    "n:*" always holds it; where that isn't given, "n:*" is all from n on."""
    single: list[int] = []
    tests: list[Column] = []
    for part in value if isinstance(value, (list, tuple)) else str(value).split(","):
        low, colon, high = str(part).strip().partition(":")
        if "*" in (low, high):
            ends = [int(x) for x in (low, high) if x not in ("*", "")]
            if highest is None and not ends:
                raise CriteriaError("* alone needs the highest uid")
            start = F.lit(ends[0]) if ends else highest
            tests.append(F.col("uid") >= (start if highest is None else F.least(start, highest) if ends else highest))
        elif not colon:
            single.append(int(low))
        else:
            a, b = sorted((int(low), int(high)))
            tests.append(F.col("uid").between(a, b))
    if single:
        tests.append(F.col("uid").isin(single))
    return reduce(lambda a, b: a | b, tests)


def asks_for_highest(criteria: Any) -> bool:
    """Whether a `*` stands anywhere after UID."""
    if not isinstance(criteria, (list, tuple)):
        return False
    after = [value for key, value in zip(criteria, criteria[1:], strict=False) if str(key).upper().removeprefix("!") == "UID"]
    return any("*" in str(value) for value in after) or any(map(asks_for_highest, criteria))


def _header(field: str, part: str) -> Column:
    """One of a head's fields, whatever the case of its name: one of the table's own columns, or any
    value of a further field. An empty part asks whether there is such a field."""
    name = field.lower()
    if name in ("to", "cc"):
        return any_contains(name, part) if part else F.size(no_array(name)) > 0
    if name in ("from", "subject"):
        return contains_text(name, part)
    return F.exists(no_array(F.try_element_at("headers", F.lit(name))), lambda x: contains_text(x, part))


def _head(part: str) -> Column:
    own = contains_text("subject", part) | contains_text("from", part) | any_contains("to", part) | any_contains("cc", part)
    return own | F.exists(no_array(F.flatten(F.map_values("headers"))), lambda x: contains_text(x, part))


def _body(part: str) -> Column:
    return contains_text("bodyText", part) | contains_text("html", part)


#: Key: (number of arguments, column).
KEYS: dict[str, tuple[int, Any]] = {
    "ALL": (0, lambda: F.lit(True)),
    **{name: (0, lambda f=f: flag(f)) for name, f in (("SEEN", SEEN), ("ANSWERED", ANSWERED), ("FLAGGED", FLAGGED), ("DELETED", DELETED), ("DRAFT", DRAFT), ("RECENT", RECENT))},
    **{"UN" + name: (0, lambda f=f: ~flag(f)) for name, f in (("SEEN", SEEN), ("ANSWERED", ANSWERED), ("FLAGGED", FLAGGED), ("DELETED", DELETED), ("DRAFT", DRAFT))},
    "OLD": (0, lambda: ~flag(RECENT)),
    "NEW": (0, lambda: flag(RECENT) & ~flag(SEEN)),
    "KEYWORD": (1, flag),
    "UNKEYWORD": (1, lambda name: ~flag(name)),
    "FROM": (1, lambda part: contains_text("from", part)),
    "TO": (1, lambda part: any_contains("to", part)),
    "CC": (1, lambda part: any_contains("cc", part)),
    "BCC": (1, lambda part: _header("bcc", part)),
    "SUBJECT": (1, lambda part: contains_text("subject", part)),
    "BODY": (1, _body),
    "TEXT": (1, lambda part: _head(part) | _body(part)),
    "HEADER": (2, _header),
    "SINCE": (1, lambda d: _since("internal_date", d)),
    "BEFORE": (1, lambda d: _before("internal_date", d)),
    "ON": (1, lambda d: _on("internal_date", d)),
    "SENTSINCE": (1, lambda d: _since("date", d)),
    "SENTBEFORE": (1, lambda d: _before("date", d)),
    "SENTON": (1, lambda d: _on("date", d)),
    "LARGER": (1, lambda n: F.col("size") > int(n)),
    "SMALLER": (1, lambda n: F.col("size") < int(n)),
    "UID": (1, _uids),
}


def negated(test: Column) -> Column:
    """A test of what isn't there fails, so its negation holds. Only here is null made false:
    elsewhere a filter drops null itself, and plain comparisons reach the scan."""
    return ~F.coalesce(test, F.lit(False))


def _take(parts: list, at: int, highest: Column | None) -> tuple[Column, int]:
    """The column of the criterion that begins at a place, and the place after it."""
    if at >= len(parts):
        raise CriteriaError("a criterion is missing at the end")
    part = parts[at]
    if isinstance(part, (list, tuple)):
        return compile_criteria(part, highest), at + 1
    key = str(part).upper()
    if key == "NOT":
        inner, at = _take(parts, at + 1, highest)
        return negated(inner), at
    if key == "OR":
        one, at = _take(parts, at + 1, highest)
        other, at = _take(parts, at, highest)
        return one | other, at
    if (known := KEYS.get(key.removeprefix("!"))) is None:
        raise CriteriaError(f"unknown criterion: {part}")
    count, make = known
    arguments = parts[at + 1 : at + 1 + count]
    if len(arguments) < count:
        raise CriteriaError(f"{key} needs {count} argument(s)")
    try:
        column = make(*arguments, highest) if make is _uids else make(*arguments)
    except CriteriaError:
        raise
    except (TypeError, ValueError) as error:
        raise CriteriaError(f"{key}: {error}") from error
    return (negated(column) if key.startswith("!") else column), at + 1 + count


def compile_criteria(criteria: list | tuple | str | None, highest: Column | None = None) -> Column:
    """The test of a message that criteria ask for; highest: the folder's highest uid, for `*`."""
    parts = [criteria] if isinstance(criteria, str) else list(criteria or [])
    tests, at = [], 0
    while at < len(parts):
        test, at = _take(parts, at, highest)
        tests.append(test)
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


#: A text that a message must have somewhere, or several of which it must have all ("and") or one ("or").
Needed = str | tuple[str, list]
#: Keys whose last argument must occur in a message, as it is or in another case.
TEXTS = ("FROM", "TO", "CC", "BCC", "SUBJECT", "BODY", "TEXT", "HEADER")


def needed(criteria: list | tuple | str | None) -> Needed | None:
    """What the texts of each message that meets the criteria must have; None where that says nothing."""
    parts = [criteria] if isinstance(criteria, str) else list(criteria or [])
    found, at = [], 0
    while at < len(parts):
        one, at = _needed_at(parts, at)
        found += [] if one is None else [one]
    return None if not found else found[0] if len(found) == 1 else ("and", found)


def _needed_at(parts: list, at: int) -> tuple[Needed | None, int]:
    if at >= len(parts):
        raise CriteriaError("a criterion is missing at the end")
    part = parts[at]
    if isinstance(part, (list, tuple)):
        return needed(part), at + 1
    key = str(part).upper()
    if key == "NOT":
        return None, _needed_at(parts, at + 1)[1]
    if key == "OR":
        one, at = _needed_at(parts, at + 1)
        other, at = _needed_at(parts, at)
        return (None if one is None or other is None else ("or", [one, other])), at
    if (known := KEYS.get(key.removeprefix("!"))) is None:
        raise CriteriaError(f"unknown criterion: {part}")
    after = at + 1 + known[0]
    text = str(parts[after - 1]).lower() if key in TEXTS and after <= len(parts) else ""
    return text or None, after

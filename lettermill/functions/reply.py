"""Prompts for models, and the JSON in their replies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import if_empty

TEXT_IN_PROMPT = 1000
ANALYSIS = "category string, priority string, summary string, action string, key_info string"
CATEGORIES = ("work", "personal", "newsletter", "spam", "notification", "urgent")
PRIORITIES = ("high", "medium", "low")
ACTIONS = ("respond", "archive", "read-later", "delete", "forward")

#: The prompt, with what is said of the message in braces, and what stands for no text.
NO_TEXT = "No text content available"
TEMPLATE = (
    "Analyze this email and provide a structured assessment:\n\nFrom: {sender}\nSubject: {subject}\nDate: {date}\nContent: {text}"
    "\n\nPlease provide:\n1. Category (work/personal/newsletter/spam/notification/urgent)\n2. Priority (high/medium/low)\n3. Brief summary (max 50 words)\n"
    "4. Suggested action (respond/archive/read-later/delete/forward)\n5. Key information extracted\n\nReturn as JSON format."
)


def prompt(sender: Column, subject: Column, date: Column, text: Column) -> Column:
    """What a model is asked about one message: its head, and the first part of its text."""
    body = if_empty(F.substring(F.coalesce(text, F.lit("")), 1, TEXT_IN_PROMPT), NO_TEXT)
    said = {"sender": sender, "subject": subject, "date": date, "text": body}
    pieces = re.split(r"\{(\w+)\}", TEMPLATE)
    return F.concat(*(said[piece] if i % 2 else F.lit(piece) for i, piece in enumerate(pieces)))


def first_braces(reply: Column) -> Column:
    """From the first { to the first } after it; null if there is none. Nested objects are cut."""
    return F.nullif(F.regexp_extract(reply, r"\{[\s\S]*?\}", 0), F.lit(""))


def balanced_braces(reply: Column) -> Column:
    """From the first { to its own }, nested ones included to a depth of four; null if none."""
    inner = r"\{[^{}]*+\}"
    for _ in range(3):
        inner = r"\{(?:[^{}]|" + inner + r")*+\}"
    return F.nullif(F.regexp_extract(reply, inner, 0), F.lit(""))


def analysis_text(reply: Column) -> Column:
    """The JSON of the reply, or the reply as it is where that can't be parsed. Keys are sorted."""
    return F.coalesce(F.to_json(F.try_parse_json(first_braces(reply))), reply)


def analysis(reply: Column) -> Column:
    """The reply's fields; all null where its JSON can't be parsed."""
    return F.from_json(F.coalesce(first_braces(reply), F.lit("{}")), ANALYSIS)


def valid(fields: Column) -> Column:
    """Whether category, priority and action are among the known ones: an addition of ours."""
    return F.coalesce(fields["category"].isin(*CATEGORIES) & fields["priority"].isin(*PRIORITIES) & fields["action"].isin(*ACTIONS), F.lit(False))

"""Analysis of messages by a model behind a pluggable backend."""

from __future__ import annotations

import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reply as R
from ..functions.text import shown_date
from ..scratch import scratch_folder

#: What a model is told, and the limits of a call.
SYSTEM = "You are an intelligent email analyst. Analyze emails and return structured JSON responses with accurate categorization and actionable insights."
TEMPERATURE, MAX_TOKENS, SECONDS = 0.3, 300, 30


class Prompt(str):
    """What a backend gets: the prompt as text, with the limits that its call should keep to."""

    system, temperature, max_tokens, seconds = SYSTEM, TEMPERATURE, MAX_TOKENS, SECONDS


Backend = Callable[[Prompt], str]


def with_prompt(messages: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("bodyText"), F.lit(""))
    return messages.withColumn("prompt", R.prompt(F.coalesce("from", F.lit("")), F.coalesce("subject", F.lit("")), F.coalesce(shown_date("date"), F.lit("")), text))


def rule_reply(sender: Column, subject: Column, text: Column) -> Column:
    """A stand-in for a model, made of columns: a reply with JSON in it, by simple rules."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  (value is computed once)

    def kind(low: Column) -> Column:
        return F.when(low.rlike("urgent|asap"), "urgent").when(low.rlike("unsubscribe|newsletter"), "newsletter").when(low.rlike("winner|casino"), "spam").when(sender.rlike("(?i)noreply|no-reply"), "notification").otherwise("work")

    def said(category: Column) -> Column:
        priority = F.when(category == "urgent", "high").when(category.isin("newsletter", "spam"), "low").otherwise("medium")
        action = F.when(category == "urgent", "respond").when(category == "spam", "delete").when(category == "newsletter", "archive").otherwise("read-later")
        fields = F.struct(category.alias("category"), priority.alias("priority"), F.substring(F.regexp_replace(subject, r"[{}\"\\]", ""), 1, 60).alias("summary"), action.alias("action"), F.lit("none").alias("key_info"))
        return F.concat(F.lit("Here is the assessment: "), F.to_json(fields), F.lit(" Anything else?"))

    return let(let(F.lower(F.concat(subject, F.lit(" "), text)), kind), said)


class _Call:
    """One prompt's call in a thread of its own, which nothing waits for beyond the limit."""

    def __init__(self, backend: Backend, prompt: str, seconds: float, tries: int):
        self.reply = self.error = None
        self.tries, self.ends, self.done = 0, time.monotonic() + seconds, threading.Event()
        threading.Thread(target=self._run, args=(backend, prompt, tries), daemon=True).start()

    def _run(self, backend: Backend, prompt: str, tries: int) -> None:
        error = None
        while self.tries < tries and time.monotonic() < self.ends:
            self.tries += 1
            try:
                self.reply, error = backend(Prompt(prompt)), None
                break
            except Exception as e:  # one message's failure is that message's result
                error = str(e)
        self.error = error
        self.done.set()

    def result(self, seconds: float) -> tuple[str | None, str | None, int]:
        if not self.done.wait(max(0.0, self.ends - time.monotonic())):
            return None, f"no reply within {seconds:g} s", self.tries
        return self.reply, self.error, self.tries


REPLY = "digest string, reply string, error string, tries int"


def ask(prompted: DataFrame, backend: Backend, replies: str | None = None, window: int = 8, seconds: float = SECONDS, tries: int = 2) -> DataFrame:
    """prompted with the backend's reply to each prompt, and the error's text where there is none.

    Equal prompts are asked once. Each task has `window` calls under way at most; a call is tried again
    where it raises, and given up after so many seconds in all: a backend that hangs ends nothing but
    its own prompt. The backend is sent to executors, so it must be picklable.

    replies: a folder of replies by the digest of their prompts, to which new ones are added. What it
    has is not asked again; prompts that failed are. Without it a folder of this call is used. Calls
    are made here, not when the result is read, and not again if it is read twice. A null prompt has
    neither reply nor error. prompted is read two times, and once more where there are replies: digests
    alone say what is new, so prompts that are known aren't shuffled.
    """
    spark, path, run_id = prompted.sparkSession, replies or scratch_folder(prompted.sparkSession), uuid.uuid4().hex
    schema = f"{REPLY}, run string"
    keyed = prompted.withColumn("own digest", F.sha2(F.col("prompt"), 256))
    fresh = keyed.where("prompt IS NOT NULL").select(F.col("own digest").alias("digest"), "prompt")
    new = f"{path}/_new-{run_id}"  # readers of the folder pass over such names
    if _has_files(spark, path):
        asked = spark.read.schema(schema).parquet(path).where("error IS NULL").select("digest")
        fresh.select("digest").distinct().join(asked, "digest", "left_anti").write.parquet(new)
        fresh = fresh.join(spark.read.schema("digest string").parquet(new), "digest", "left_semi")
    fresh = fresh.dropDuplicates(["digest"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: deque[tuple[str, _Call]] = deque()

        def first() -> tuple:
            digest, call = waiting.popleft()
            return (digest, *call.result(seconds))

        for batch in batches:
            rows = []
            for digest, prompt in zip(batch["digest"], batch["prompt"], strict=True):
                if len(waiting) >= window:
                    rows.append(first())
                waiting.append((digest, _Call(backend, prompt, seconds, tries)))
            if rows:
                yield pd.DataFrame(rows, columns=["digest", "reply", "error", "tries"])
        if waiting:
            yield pd.DataFrame([first() for _ in range(len(waiting))], columns=["digest", "reply", "error", "tries"])

    fresh.mapInPandas(run, REPLY).withColumn("run", F.lit(run_id)).write.mode("append").parquet(path)
    if _has_files(spark, new):
        at = spark._jvm.org.apache.hadoop.fs.Path(new)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    # Of a prompt that two runs asked at once, one reply counts; of failures, this run's.
    known = spark.read.schema(schema).parquet(path).where(F.col("error").isNull() | (F.col("run") == run_id))
    known = known.groupBy("digest").agg(F.min(F.struct(F.col("error").isNotNull().alias("failed"), "reply", "error")).alias("own said"))
    said = keyed.join(known, F.col("own digest") == F.col("digest"), "left")
    return said.select(*prompted.columns, F.col("own said.reply").alias("reply"), F.col("own said.error").alias("error"))


def _has_files(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def with_analysis(replied: DataFrame) -> DataFrame:
    """replied with analysis (text), fields and valid, from its `reply` column."""
    out = replied.withColumn("analysis", R.analysis_text(F.col("reply"))).withColumn("fields", R.analysis(F.col("reply")))
    return out.withColumn("valid", R.valid(F.col("fields")))


def analyze(messages: DataFrame, backend: Backend | None = None, **limits: Any) -> DataFrame:
    """uid, reply, analysis, fields, valid of each message; by rules without a backend. With one, its
    errors too; limits: those of `ask`."""
    prompted = with_prompt(messages)
    if backend is None:
        replied = prompted.withColumn("reply", rule_reply(F.coalesce("from", F.lit("")), F.coalesce("subject", F.lit("")), F.coalesce("bodyText", F.lit(""))))
        return with_analysis(replied).select("uid", "reply", "analysis", "fields", "valid")
    return with_analysis(ask(prompted.select("uid", "prompt"), backend, **limits)).select("uid", "reply", "error", "analysis", "fields", "valid")

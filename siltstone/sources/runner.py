"""The outside call: requests go to a runner, replies come back as rows.

A runner is made in each Python worker by a factory that can be pickled, so that clients and connections
are never shipped. Requests carry what the model is to see in cache-stable order: the document, then
instructions, scope and feedback.
"""

from __future__ import annotations

import inspect
import json
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.quota import Quota

REPLY = "call_key string, data string, history string, error string"
REQUEST = ["doc_id", "call_key", "instructions", "contract", "content", "scope", "history", "feedback"]
#: Columns that requests may have beside these, with their types: what is prepended as messages of its own, tools by
#: name, how many of the leading messages a provider may keep, and the tokens that a call is thought to take.
FURTHER = {"prompt_parts": "array<string>", "tools": "array<string>", "cache_blocks": "int", "tokens": "long"}
#: Characters in a token.
CHARS_PER_TOKEN = 1.6


class Runner(Protocol):
    def run(self, *, instructions: str, contract: dict, content: str, scope: str = "", history: Any = None, feedback: list | None = None, prompt_parts: list[str] | None = None, tools: list[str] | None = None, cache_blocks: int | None = None) -> tuple:
        """(data, history) or (data, history, tokens): the reply, what is handed back unread with the next request of the same call, and what it took.

        A runner that does not name the last three parameters is called without them.
        """


class Pace:
    """One task's share of a quota: calls and tokens by the second, with what ``burst`` seconds allow at once."""

    def __init__(self, share: Quota, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rates = [share.calls_per_second, share.tokens_per_second]
        self.burst, self.clock, self.sleep, self.lock = share.burst, clock, sleep, threading.Lock()
        #: When each rate's account will be even again.
        self.even = [clock()] * 2

    def wait(self, tokens: float) -> None:
        """Take one call and so many tokens, and wait until both rates allow it."""
        with self.lock:
            now = self.clock()
            delay = 0.0
            for n, (rate, amount) in enumerate(zip(self.rates, (1, tokens), strict=True)):
                if rate:
                    delay = max(delay, self.even[n] - self.burst - now)
                    self.even[n] = max(self.even[n], now) + amount / rate
        if delay > 0:
            self.sleep(delay)

    def correct(self, thought: float, took: float) -> None:
        """What a call took instead of what it was thought to take."""
        if self.rates[1]:
            with self.lock:
                self.even[1] += (took - thought) / self.rates[1]


def ask(requests: DataFrame, factory: Callable[[], Runner], quota: Quota | None = None) -> DataFrame:
    """Replies to ``requests (doc_id, call_key, instructions, contract, content, scope, history, feedback)`` and columns of ``FURTHER``.

    Requests are dealt by document and call, so that one document's calls go to many tasks. Tasks times calls at a
    time in each are no more than the quota's concurrency, and each task keeps its share of the rates. A request that
    fails has an error and no data, so one document cannot fail the others.
    """
    further = [n for n in FURTHER if n in requests.columns]
    rows = requests.select(*REQUEST, *further)
    share = None
    if quota is not None:
        tasks = min(quota.concurrency, requests.sparkSession.sparkContext.defaultParallelism)
        share = quota.share(tasks)
        rows = rows.repartition(tasks, "doc_id", "call_key")
    kind = requests.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(share or Quota(1))
        own = threading.local()

        def answer(row) -> tuple:
            if not hasattr(own, "runner"):
                own.runner = factory()
                named = inspect.signature(own.runner.run).parameters
                open_ = any(p.kind is p.VAR_KEYWORD for p in named.values())
                own.takes = [n for n in ("prompt_parts", "tools", "cache_blocks") if n in further and (open_ or n in named)]
            try:
                request = {"instructions": row.instructions or "", "contract": json.loads(row.contract or "{}"), "content": row.content or "", "scope": row.scope or ""}
                request |= {n: json.loads(getattr(row, n)) if getattr(row, n) else None for n in ("history", "feedback")}
                for n in own.takes:
                    value = getattr(row, n)
                    request[n] = None if value is None else int(value) if n == "cache_blocks" else list(value)
                thought = float(getattr(row, "tokens", 0) or 0) or (len(request["instructions"]) + len(request["content"]) + len(request["scope"])) / CHARS_PER_TOKEN
                pace.wait(thought)
                data, after, *took = own.runner.run(**request)
                if took:
                    pace.correct(thought, took[0])
                return row.doc_id, row.call_key, json.dumps(data, ensure_ascii=False), json.dumps(after, ensure_ascii=False), None
            except Exception as error:  # a runner may raise anything
                return row.doc_id, row.call_key, None, None, f"{type(error).__name__}: {error}"

        with ThreadPoolExecutor(share.concurrency if share else 1) as calls:
            for frame in frames:
                yield pd.DataFrame(list(calls.map(answer, frame.itertuples(index=False))), columns=["doc_id", "call_key", "data", "history", "error"])

    return rows.mapInPandas(run, f"doc_id {kind}, {REPLY}")


def scripted(requests: DataFrame, script: DataFrame) -> DataFrame:
    """Replies from a table ``(doc_id, call_key, data[, history])``: a stand-in for a runner, as a join."""
    history = F.col("history") if "history" in script.columns else F.lit(None).cast("string").alias("history")
    told = script.select("doc_id", "call_key", "data", history)
    found = requests.select("doc_id", "call_key").join(told, ["doc_id", "call_key"], "left")
    return found.withColumn("error", F.when(F.col("data").isNull(), "no reply is scripted"))


class ScriptedRunner:
    """Replies one after another, for tests of a single worker; what was asked is kept."""

    def __init__(self, replies: list):
        self.replies, self.asked = list(replies), []

    def run(self, **request: Any) -> tuple[Any, Any]:
        self.asked.append(request)
        reply = self.replies.pop(0)
        return reply if isinstance(reply, tuple) else (reply, {"n": len(self.asked)})


#: The judge's contract.
VERDICT = {"type": "object", "properties": {"ok": {"type": "boolean"}, "reason": {"type": "string"}}, "required": ["ok", "reason"], "additionalProperties": False}
JUDGE = "Below are a source text and a result that was extracted from it. Say whether this holds for the result, word for word and with its exceptions:\n{rubric}\nBefore you name a fault, find the place in the result that shows it. Answer with ok and a one-sentence reason."


def judged(cases: DataFrame, rubric: str, factory: Callable[[], Runner], instructions: str | None = None) -> DataFrame:
    """``doc_id, ok, reason`` for ``cases (doc_id, source, output)``; a reply without a verdict is not ok."""
    from siltstone.plans.schema import require_slots

    if instructions is not None:
        require_slots(instructions, ["rubric"], "the judge's instructions")
    text = (instructions or JUDGE).format(rubric=rubric)
    content = F.concat(F.lit("Source:\n\n"), "source", F.lit("\n\n---\nOutput:\n\n"), "output")
    none = F.lit(None).cast("string")
    asked = cases.select("doc_id", F.lit("judge").alias("call_key"), F.lit(text).alias("instructions"), F.lit(json.dumps(VERDICT)).alias("contract"), content.alias("content"), F.lit("").alias("scope"), none.alias("history"), none.alias("feedback"))
    verdict = F.from_json("data", "ok boolean, reason string")
    return ask(asked, factory).select("doc_id", F.coalesce(verdict["ok"], F.lit(False)).alias("ok"), F.coalesce(verdict["reason"], F.lit("")).alias("reason"))

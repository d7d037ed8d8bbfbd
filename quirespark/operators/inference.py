"""Model calls as a table operator: requests in, replies out, errors as a column.

A call is a side effect that Spark may repeat, so requests are keyed, replies belong in a table, and later stages read that.
Parallelism is the number of partitions. Retries happen within a row, by a policy that knows no clock of its own.
"""

from __future__ import annotations

import base64
import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ModelClient(Protocol):
    """Answers a prompt, with an image or without."""

    def complete(self, prompt: str, system: str, model: str, image: bytes | None = None) -> str: ...


class NoReply(RuntimeError):
    """The model's reply was empty."""


@dataclass(frozen=True)
class RetryPolicy:
    """max_retries + 1 attempts; the wait grows by `growth` each time; the last error is raised."""

    max_retries: int = 3
    delay: float = 1.0
    growth: float = 1.5
    sleep: Callable[[float], None] = field(default=time.sleep, compare=False)

    def waits(self) -> list[float]:
        return [self.delay * self.growth**k for k in range(self.max_retries)]

    def run(self, call: Callable[[], str]) -> tuple[str, int]:
        """(reply, attempts)"""
        for attempt, wait in enumerate([*self.waits(), None], 1):
            try:
                reply = call()
                if not reply or not reply.strip():
                    raise NoReply("empty reply")
                return reply, attempt
            except Exception:
                if wait is None:
                    raise
                self.sleep(wait)
        raise AssertionError


@dataclass
class ReplayClient:
    """Replies that were recorded by prompt; unknown prompts fail."""

    replies: dict[str, str]

    def complete(self, prompt: str, system: str, model: str, image: bytes | None = None) -> str:
        return self.replies[prompt]


@dataclass
class StubClient:
    """Replies by a function of the prompt."""

    answer: Callable[[str], str]

    def complete(self, prompt: str, system: str, model: str, image: bytes | None = None) -> str:
        return self.answer(prompt)


@dataclass
class HttpClient:
    """A server with the common chat-completions interface. The key comes from the caller, and is never written anywhere."""

    base_url: str
    key: str = field(repr=False)
    timeout: float = 60.0

    def complete(self, prompt: str, system: str, model: str, image: bytes | None = None) -> str:
        import json
        from urllib.request import Request, urlopen

        content: object = prompt
        if image is not None:
            content = [{"type": "image_url", "image_url": {"url": "data:image/jpeg;base64," + base64.b64encode(image).decode()}}, {"type": "text", "text": prompt}]
        body = json.dumps({"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": content}]}).encode()
        request = Request(f"{self.base_url.rstrip('/')}/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]


def api_status(key: str | None, base_url: str) -> dict[str, object]:
    """Whether a key is configured, and for which server; the key itself isn't shown."""
    return {"api_key_configured": bool(key), "base_url": base_url}


def request_key(*parts: Column) -> Column:
    """A stable key of a request: the hash of what identifies it and of its prompt."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256)


REPLIES = pa.schema([("request_key", pa.string()), ("reply", pa.string()), ("attempts", pa.int32()), ("error", pa.string())])


def call(requests: DataFrame, client: Callable[[], ModelClient], model: str, system: str = "", policy: RetryPolicy = RetryPolicy(), parallelism: int | None = None) -> DataFrame:
    """(request_key, reply, attempts, error) of requests (request_key, prompt[, image]). A request that fails has a null reply and its error; the others go on.

    client() is called once per task. `parallelism` bounds the calls at a time.
    """
    has_image = "image" in requests.columns
    rows = requests.select("request_key", "prompt", *(["image"] if has_image else []))
    if parallelism:
        rows = rows.repartition(parallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = client()
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    reply, attempts = policy.run(lambda r=r: to.complete(r["prompt"], system, model, r.get("image")))
                    row = (r["request_key"], reply, attempts, None)
                except Exception as e:  # isolates the row
                    row = (r["request_key"], None, policy.max_retries + 1, f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, REPLIES, strict=True)], schema=REPLIES)

    return rows.mapInArrow(run, "request_key string, reply string, attempts int, error string")


def detect_tables(pages: DataFrame, client: Callable[[], ModelClient], precheck_prompt: str, detect_prompt: str, precheck_model: str, model: str, policy: RetryPolicy = RetryPolicy()) -> DataFrame:
    """Replies about pages (request_key, image) that a cheaper model says hold a table: two stages, as the plan can't reorder calls."""
    from quirespark.operators.qa import YES

    first = call(pages.withColumn("prompt", F.lit(precheck_prompt)), client, precheck_model, policy=policy).filter(F.instr("reply", YES) > 0)
    return call(pages.join(first.select("request_key"), "request_key", "left_semi").withColumn("prompt", F.lit(detect_prompt)), client, model, policy=policy)


def prompt_hash(prompt: str) -> str:
    return hashlib.sha256(prompt.encode()).hexdigest()

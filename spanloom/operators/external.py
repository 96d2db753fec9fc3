"""An aligner outside Spark, one call a sentence, behind a provider that can be swapped."""

from __future__ import annotations

import json
import os
import time
import urllib.request
import uuid
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import Config
from ..plans.shared import shared_dir
from . import journal

#: Under this confidence a span is a warning.
SURE = 0.9


class Provider(Protocol):
    """Must be picklable; called in the executors, by several threads of a task."""

    def align(self, sentence: str, words: list[dict]) -> tuple[int, int, float] | None:
        """(start_ms, end_ms, confidence) or None; may raise, and is called again then."""


class ExactProvider:
    """Offline stand-in: the first place where the sentence's words stand one after the other."""

    def align(self, sentence: str, words: list[dict]) -> tuple[int, int, float] | None:
        from ..functions.text import normalize_text, token_list

        wanted, spoken = token_list(sentence), [normalize_text(w["text"]) for w in words]
        for i in range(len(spoken) - len(wanted) + 1 if wanted else 0):
            if spoken[i : i + len(wanted)] == wanted:
                return int(words[i]["start"]), int(words[i + len(wanted) - 1]["end"]), 0.95
        return None


def compact_words(words: Column) -> Column:
    """The words as JSON without white space: text, start and end alone."""
    return F.to_json(F.transform(words, lambda w: F.struct(w["text"].alias("text"), w["start"].alias("start"), w["end"].alias("end"))))


def prompt(sentence: str, words: list[dict]) -> str:
    spoken = json.dumps([{k: w[k] for k in ("text", "start", "end")} for w in words], separators=(",", ":"), ensure_ascii=False)
    return (
        f"Words with their times in ms: {spoken}\nFind where this sentence is spoken, allowing for marks, contractions and small changes of words: {json.dumps(sentence, ensure_ascii=False)}\n"
        "Reply with JSON alone: start_ms of its first word, end_ms of its last word, and confidence from 0 to 1 (1 for an exact match, under 0.8 for a guess)."
    )


@dataclass(frozen=True)
class ChatProvider:
    """A chat service that answers POST requests with choices[0].message.content, a JSON object with start_ms, end_ms and confidence.

    The key is read in the executors from the environment variable key_variable names; it is part of neither plan nor journal.
    """

    url: str
    model: str
    key_variable: str | None = None
    temperature: float = 0.1
    max_tokens: int = 200
    timeout: float = 30

    @property
    def settings(self) -> str:
        return json.dumps([self.url, self.model, self.temperature, self.max_tokens])

    def align(self, sentence: str, words: list[dict]) -> tuple[int, int, float] | None:
        headers = {"Content-Type": "application/json"}
        if self.key_variable:
            headers["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        body = {"model": self.model, "temperature": self.temperature, "max_tokens": self.max_tokens, "messages": [{"role": "user", "content": prompt(sentence, words)}]}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            content = json.load(reply)["choices"][0]["message"]["content"]
        found = json.loads(content) if content else None
        return (found["start_ms"], found["end_ms"], found["confidence"]) if found else None


def valid_reply(start_ms: float, end_ms: float, confidence: float) -> bool:
    """Bounds of a reply: times from 0, confidence from 0 to 1. The end may lie before the start."""
    return start_ms >= 0 and end_ms >= 0 and 0 <= confidence <= 1


def ask(provider: Provider, sentence: str, words: list[dict], retries: int, delay: float) -> dict:
    """A reply as the journal keeps it. status: found; none, if the service has no times; failed, if every call raised or was out of bounds; error, if a reply can't be read."""
    for attempt in range(retries):
        if attempt:
            time.sleep(delay)
        try:
            reply = provider.align(sentence, words)
        except Exception:  # whatever a remote service may raise
            continue
        if reply is None:
            return {"status": "none"}
        try:
            if valid_reply(*reply):
                return {"status": "found", "start_ms": int(reply[0]), "end_ms": int(reply[1]), "confidence": float(reply[2])}
        except (TypeError, ValueError) as fault:
            return {"status": "error", "note": f"{type(fault).__name__}: {fault}"}
    return {"status": "failed"}


def align_external(docs: DataFrame, provider: Provider, config: Config = Config(), path: str | None = None) -> DataFrame:
    """Rows as of align() without word places, but with the confidence, for docs (doc_id, sentences, words).

    status is ok, warning (confidence under 0.9), failed or error. The calls are made here, once for each different sentence of a
    word stream, and kept in the journal at path (by default config.external.journal, or else a new one in the shared folder), by sentence, words and
    settings; the result reads the journal and calls nothing. A task calls for up to max_workers sentences at a time; sentences are
    independent, so spans may overlap.
    """
    ext, pad, spark = config.external, config.pad_ms, docs.sparkSession
    path = path or ext.journal or f"{shared_dir(spark)}/spanloom/calls-{uuid.uuid4().hex}"
    settings = getattr(provider, "settings", f"{type(provider).__module__}.{type(provider).__qualname__} {ext.temperature} {ext.max_tokens}")
    stream = F.sha2(F.concat(F.lit(settings + "\n"), F.coalesce(compact_words(F.col("words")), F.lit(""))), 256)
    docs = docs.select("doc_id", "sentences", "words", stream.alias("_stream"))
    docs = docs.withColumn("keys", F.transform("sentences", lambda s: F.sha2(F.concat(F.col("_stream"), s), 256)))
    retries, delay = ext.max_retries, ext.retry_delay
    found = journal.call(docs, path, lambda sentence, words: ask(provider, sentence, words, retries, delay), ext.max_workers, ext.calls_per_second)

    rows = docs.select("doc_id", F.posexplode(F.arrays_zip("keys", "sentences")).alias("pos", "s")).select("doc_id", (F.col("pos") + 1).alias("idx"), F.col("s.sentences").alias("text"), F.col("s.keys").alias("key"))
    met = rows.join(found.withColumnRenamed("status", "reply"), "key", "left")
    here = F.col("reply") == "found"
    status = F.when(here & (F.col("confidence") >= SURE), "ok").when(here, "warning").when(F.col("reply") == "error", "error").otherwise("failed")
    note = F.when(F.col("status") == "ok", "").when(F.col("status") == "warning", "low confidence").when(F.col("status") == "error", F.col("note")).otherwise("no times found")
    met = met.withColumn("status", status).withColumn("note", note)
    return met.select(
        "doc_id", "idx", "text", "status", F.lit(None).cast("double").alias("score"), "note",
        F.when(here, F.greatest(F.lit(0), F.col("start_ms") - pad)).alias("start_ms"), F.when(here, F.col("end_ms") + pad).alias("end_ms"), "confidence",
    )

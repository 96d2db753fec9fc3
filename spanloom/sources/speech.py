"""Word streams from recordings, by a recognition service behind a provider that can be swapped."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

from pyspark.sql import DataFrame

RESULT = "audio_id string, language_code string, text string, status string, audio_duration double, words array<struct<text:string,start:bigint,end:bigint,confidence:double,speaker:string>>"


class Transcriber(Protocol):
    """Must be picklable; called in the executors."""

    def transcribe(self, content: bytes, language: str) -> list[dict]:
        """Words with text, start and end in ms, and confidence and speaker if known. May raise."""


class FixedTranscriber:
    """Offline stand-in: the same words for every recording, `step` ms apart."""

    def __init__(self, text: str, step: int = 300):
        self.text, self.step = text, step

    def transcribe(self, content: bytes, language: str) -> list[dict]:
        return [{"text": w, "start": i * self.step, "end": (i + 1) * self.step, "confidence": 1.0} for i, w in enumerate(self.text.split())]


def transcribe(recordings: DataFrame, provider: Transcriber, language: str = "en", at_once: int = 5) -> DataFrame:
    """(doc_id, RESULT) of recordings (doc_id, content, duration_ms), in the form of a word file; status is error where no words came.

    A task calls the service for up to at_once recordings at a time.
    """
    kind = recordings.schema["doc_id"].dataType.simpleString()
    names = ("text", "start", "end", "confidence", "speaker")

    def run(batches):
        import pandas as pd

        def ask(content):
            try:
                return [{k: w.get(k) for k in names} for w in provider.transcribe(bytes(content), language)]
            except Exception:  # whatever a remote service may raise
                return []

        for batch in batches:
            rows = []
            with ThreadPoolExecutor(at_once) as pool:
                found = list(pool.map(ask, batch["content"]))
            for doc, words, ms in zip(batch["doc_id"], found, batch["duration_ms"], strict=True):
                rows.append((doc, str(doc), language, " ".join(w["text"] for w in words), "completed" if words else "error", ms / 1000.0, words))
            yield pd.DataFrame(rows, columns=["doc_id", "audio_id", "language_code", "text", "status", "audio_duration", "words"])

    return recordings.select("doc_id", "content", "duration_ms").mapInPandas(run, f"doc_id {kind}, {RESULT}")

"""Sound as 16-bit PCM: headers, clips, silence, blocks."""

from __future__ import annotations

import io
import math
import struct
import wave

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.config import Config

INFO = "duration_ms long, sample_rate int, channels int"


def _chunks(content: bytes) -> tuple[tuple[int, int, int, int], int, int]:
    """(kind, channels, rate, bits) of a WAV file, and where its samples begin and end. Other files are a ValueError."""
    if content[:4] not in (b"RIFF", b"RF64") or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, long_size = 12, None, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        if name == b"ds64":
            long_size = int.from_bytes(content[at + 16 : at + 24], "little")
        elif name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, at + 8)
            if kind == 0xFFFE and size >= 26:  # the extensible form: the kind stands in its sub-format
                kind = int.from_bytes(content[at + 32 : at + 34], "little")
            form = kind, channels, rate, bits
        elif name == b"data":
            if form is None or not form[1] or not form[2] or not form[3]:
                raise ValueError("a WAV file without a format")
            size = long_size if size == 0xFFFFFFFF and long_size is not None else size
            return form, at + 8, min(len(content), at + 8 + size)
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


def wav_info(content: bytes | None) -> tuple[int, int, int]:
    """Whole ms, sample rate and channels of a WAV file; 0, 44100 and 1 for what can't be read."""
    try:
        (_, channels, rate, bits), start, end = _chunks(bytes(content or b""))
    except (ValueError, struct.error):
        return 0, 44100, 1
    return (end - start) // max(1, channels * bits // 8) * 1000 // rate, rate, channels


def audio_info(content: Column) -> Column:
    """A struct of INFO."""

    def read(contents):
        import pandas as pd

        return pd.DataFrame([wav_info(c) for c in contents], columns=["duration_ms", "sample_rate", "channels"])

    return F.pandas_udf(read, T.StructType().add("duration_ms", T.LongType()).add("sample_rate", T.IntegerType()).add("channels", T.IntegerType()))(content)


def samples(content: bytes) -> tuple[np.ndarray, int]:
    """The mean of all channels as 16-bit samples, and their rate, of WAV files of 8, 16, 24 or 32 bits or floating-point numbers; any other file is a ValueError."""
    content = bytes(content)
    (kind, channels, rate, bits), start, end = _chunks(content)
    width = bits // 8
    size = (end - start) // (width * channels) * width * channels if width else 0
    data = np.frombuffer(content, dtype=np.uint8, count=size, offset=start)
    if (kind, bits) == (1, 16):
        sound = data.view("<i2").astype(np.float64)
    elif (kind, bits) == (1, 8):
        sound = (data.astype(np.float64) - 128) * 256
    elif (kind, bits) == (1, 24):
        wide = np.zeros((size // 3, 4), dtype=np.uint8)
        wide[:, 1:] = data.reshape(-1, 3)
        sound = wide.reshape(-1).view("<i4") / 65536
    elif (kind, bits) == (1, 32):
        sound = data.view("<i4") / 65536
    elif kind == 3 and bits in (32, 64):
        sound = np.nan_to_num(data.view(f"<f{width}").astype(np.float64) * 32768)
    else:
        raise ValueError(f"WAV files of kind {kind} with {bits} bits can't be read")
    mixed = sound.reshape(-1, channels).mean(axis=1)
    return np.round(mixed).clip(-32768, 32767).astype("<i2"), rate


def resample(sound: np.ndarray, rate: int, wanted: int, half: int = 32, at_once: int = 1 << 16) -> np.ndarray:
    """The sound at another rate: each new sample is a sum of 2 * half old ones by a windowed sinc, one set of weights a phase."""
    if rate == wanted or not len(sound):
        return sound
    common = math.gcd(rate, wanted)
    up, down = wanted // common, rate // common
    edge = min(1.0, up / down)  # above the lower of both rates nothing passes
    half = math.ceil(half / edge)
    away = np.arange(1 - half, half + 1)[None, :] - np.arange(up)[:, None] / up
    weights = edge * np.sinc(edge * away) * np.cos(np.pi * away / (2 * half + 2)) ** 2
    weights /= weights.sum(axis=1, keepdims=True)
    padded, out = np.pad(sound.astype(np.float64), half), []
    length = -(-len(sound) * up // down)
    for first in range(0, length, at_once):
        at = np.arange(first, min(length, first + at_once)) * down
        near = padded[(at // up)[:, None] + np.arange(1, 2 * half + 1)[None, :]]
        out.append(np.einsum("ij,ij->i", near, weights[at % up]))
    return np.round(np.concatenate(out)).clip(-32768, 32767).astype("<i2")


def cut(sound: np.ndarray, rate: int, start_ms: int, end_ms: int, fade_ms: int = 8) -> np.ndarray:
    """The samples from start to end, at least 1 ms, faded in and out on straight lines."""
    start = max(0, start_ms)
    size = max(1, end_ms - start)
    clip = sound[start * rate // 1000 : (start + size) * rate // 1000].astype(np.float64)
    ramp = min(fade_ms * rate // 1000, len(clip))
    if ramp:
        line = np.arange(ramp) / ramp
        clip[:ramp] *= line
        clip[-ramp:] *= line[::-1]
    return np.round(clip).astype("<i2")


def silence(ms: int, rate: int) -> np.ndarray:
    return np.zeros(ms * rate // 1000, dtype="<i2")


def stretch(sound: np.ndarray, tempo: float, size: int = 1024) -> np.ndarray:
    """The sound at another tempo with its pitch: overlapping windows, each taken where it goes on best from the one before it.

    A window is looked for within a quarter of its size around its own place, by cross-correlation with what followed the window before it.
    """
    if not 0.5 <= tempo <= 2.0:
        raise ValueError("tempo must be from 0.5 to 2")
    out_len = round(len(sound) / tempo)
    if tempo == 1.0 or len(sound) < 2 * size:
        return np.resize(sound, out_len) if len(sound) else sound
    hop, near = size // 2, size // 4
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)  # two of them, half a size apart, add up to 1
    data, last = sound.astype(np.float64), len(sound) - size
    out = np.zeros(out_len + 2 * size)
    begin = 0
    for at in range(0, out_len, hop):
        if at:
            follow = min(begin + hop, last)
            low, high = (int(np.clip(at * tempo + d, 0, last)) for d in (-near, near))
            region, target = data[low : high + size], data[follow : follow + size]
            power = np.cumsum(np.concatenate(([0.0], region * region)))
            loud = np.sqrt(power[size:] - power[:-size]).clip(1e-9)
            begin = low + int(np.argmax(np.correlate(region, target, "valid") / loud))
            out[at : at + size] += data[begin : begin + size] * window
        else:
            out[:size] += data[:size] * np.where(np.arange(size) < hop, 1.0, window)
    return np.round(out[:out_len]).clip(-32768, 32767).astype("<i2")


def wav_bytes(parts: list[np.ndarray], rate: int) -> bytes:
    """One mono WAV file of the parts in order."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        for part in parts:
            w.writeframes(part.tobytes())
    return out.getvalue()


def block_bytes(clip_ms: Column, repeats: Column, config: Config) -> Column:
    """Bytes of a sentence's block: its clip `repeats` times with pauses between, and the pause after it."""
    size = lambda ms: F.floor(ms * config.sample_rate / 1000) * 2
    return (repeats * size(clip_ms) + (repeats - 1) * size(F.lit(config.pause_ms)) + size(F.lit(config.after_sentence_ms))).cast("long")


def render(recordings: DataFrame, blocks: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, wav): the dictation of each document, from recordings (doc_id, content) and with_blocks(), mono at the configured rate."""
    lists = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "start_ms", "end_ms", "num_repeats"))).alias("blocks"))
    kind = recordings.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for doc, content, plan in zip(batch["doc_id"], batch["content"], batch["blocks"], strict=True):
                sound, rate = samples(content)
                sound, rate = resample(sound, rate, config.sample_rate), config.sample_rate
                pause, after = silence(config.pause_ms, rate), silence(config.after_sentence_ms, rate)
                parts = []
                for b in plan:
                    clip = stretch(cut(sound, rate, b["start_ms"], b["end_ms"], config.fade_ms), config.tempo)
                    for rep in range(b["num_repeats"]):
                        parts += [clip, after if rep == b["num_repeats"] - 1 else pause]
                rows.append((doc, wav_bytes(parts, rate)))
            yield pd.DataFrame(rows, columns=["doc_id", "wav"])

    return recordings.join(lists, "doc_id").select("doc_id", "content", "blocks").mapInPandas(run, f"doc_id {kind}, wav binary")

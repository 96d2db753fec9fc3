import io
import struct
import wave

import numpy as np
import pytest

from spanloom.operators import audio


def wav(data: bytes, kind: int, channels: int, rate: int, bits: int, extra: bytes = b"", extensible: bool = False) -> bytes:
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    if extensible:
        form += struct.pack("<HHI", 22, bits, 0) + struct.pack("<H", kind) + b"\0" * 14
    body = b"WAVE" + extra + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def sine(hertz, rate, seconds, loud=10_000):
    return np.round(loud * np.sin(2 * np.pi * hertz * np.arange(int(rate * seconds)) / rate))


KNOWN = np.array([0, 1, -1, 100, -32768, 32767, 12345])


@pytest.mark.parametrize("extensible", [False, True])
@pytest.mark.parametrize(
    ("kind", "bits", "data", "loss"),
    [
        (1, 8, (KNOWN // 256 + 128).astype(np.uint8).tobytes(), 255),
        (1, 16, KNOWN.astype("<i2").tobytes(), 0),
        (1, 24, b"".join(int(x * 256).to_bytes(3, "little", signed=True) for x in KNOWN), 0),
        (1, 32, (KNOWN.astype("<i4") * 65536).tobytes(), 0),
        (3, 32, (KNOWN / 32768).astype("<f4").tobytes(), 0),
        (3, 64, (KNOWN / 32768).astype("<f8").tobytes(), 0),
    ],
)
def test_sample_widths(kind, bits, data, loss, extensible):
    content = wav(data, kind, 1, 8000, bits, b"LIST\x03\0\0\0abc\0", extensible)
    sound, rate = audio.samples(content)
    assert rate == 8000 and np.abs(sound.astype(int) - KNOWN).max() <= loss
    assert audio.wav_info(content) == (len(KNOWN) * 1000 // 8000, 8000, 1)


def test_channels_are_mixed():
    both = np.column_stack([np.zeros(100), sine(50, 1000, 0.1)]).astype("<i2")
    sound, _ = audio.samples(wav(both.tobytes(), 1, 2, 1000, 16))
    assert np.abs(sound - both[:, 1] / 2).max() <= 0.5


def test_a_file_of_the_standard_library():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(3)
        w.setframerate(48000)
        w.writeframes(b"".join(int(x * 256).to_bytes(3, "little", signed=True) * 2 for x in KNOWN))
    assert audio.samples(out.getvalue())[0].tolist() == KNOWN.tolist()


@pytest.mark.parametrize("content", [b"", b"ID3\x04 no sound", b"fLaC" + b"\0" * 50, b"RIFF\0\0\0\0WAVE", wav(b"\1\2", 1, 1, 8000, 12), wav(b"\1\2", 6, 1, 8000, 8), wav(b"", 1, 0, 8000, 16), b"RIFF\0\0\0\0WAVEdata\4\0\0\0abcd"])
def test_other_files_are_errors(content):
    with pytest.raises(ValueError):
        audio.samples(content)


def strongest(sound, rate):
    """Frequency and amplitude of the strongest tone, away from the ends."""
    part = sound[len(sound) // 4 : 3 * len(sound) // 4].astype(float)
    window = np.hanning(len(part))
    spectrum = np.abs(np.fft.rfft(part * window, 8 * len(part)))
    k = int(np.argmax(spectrum))
    return k * rate / (8 * len(part)), 2 * spectrum[k] / window.sum()


@pytest.mark.parametrize("tempo", [0.5, 0.75, 0.92, 1.3, 2.0])
@pytest.mark.parametrize("hertz", [110, 440, 1234.5])
def test_tempo_keeps_pitch_and_loudness(tempo, hertz):
    sound = sine(hertz, 44100, 2).astype("<i2")
    made = audio.stretch(sound, tempo)
    assert len(made) == round(len(sound) / tempo)
    pitch, loud = strongest(made, 44100)
    assert abs(pitch / hertz - 1) < 0.02 and abs(loud / 10_000 - 1) < 0.02


@pytest.mark.parametrize(("rate", "wanted"), [(8000, 44100), (48000, 44100), (44100, 16000), (22050, 44100)])
def test_rates(rate, wanted):
    sound = sine(1000, rate, 1).astype("<i2")
    made = audio.resample(sound, rate, wanted)
    assert len(made) == -(-len(sound) * wanted // rate)
    inner = slice(wanted // 10, -wanted // 10)
    assert np.abs(made[inner] - sine(1000, wanted, len(made) / wanted)[: len(made)][inner]).max() < 30
    assert np.abs(audio.resample(sine(rate / 2 - 100, rate, 0.5).astype("<i2"), rate, wanted // 4)[500:-500]).max() < 60 if wanted // 4 < rate - 200 else True


def test_recordings_of_another_kind(spark):
    from spanloom.operators import schedule
    from spanloom.plans import config

    own = config.load(tempo=1.0, pause_ms=10, inter_sentence_pause_ms=10)
    both = np.repeat(sine(440, 48000, 1)[:, None], 2, axis=1)
    rows = spark.createDataFrame([("a", wav((both / 32768).astype("<f4").tobytes(), 3, 2, 48000, 32))], "doc_id string, content binary")
    spans = spark.createDataFrame([("a", 1, 0, 1000)], "doc_id string, idx int, start_ms long, end_ms long")
    made = audio.render(rows, schedule.with_blocks(schedule.aligned_only(spans), own), own).first()
    sound, rate = audio.samples(bytes(made.wav))
    assert rate == 44100 and abs(strongest(sound[2000:42000], rate)[0] - 440) < 5

"""Signals: frames, voice activity, channel modes, and numpy kernels for spectra, embeddings and resampling."""

from __future__ import annotations

import io
import wave

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .conversation import merged_intervals

RATE = 16_000


def frames(samples: DataFrame, key: str, index: str, value: str, size: int) -> DataFrame:
    """Energy (root mean square) and zero crossings' share of every whole frame of ``size`` samples.

    The sample before a frame is of no concern to it; samples left over at the
    end make no frame.
    """
    at = F.col(index)
    rows = samples.select(key, F.call_function("div", at, F.lit(size).cast("bigint")).alias("frame"), (at % size).alias("i"), F.col(value).alias("x"))
    before = F.lag("x").over(Window.partitionBy(key, "frame").orderBy("i"))
    cross = ((F.col("x") >= 0) & (before < 0)) | ((F.col("x") < 0) & (before >= 0))
    rows = rows.withColumn("cross", F.coalesce(cross.cast("int"), F.lit(0)))
    out = rows.groupBy(key, "frame").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("energy"), (F.sum("cross") / F.count("*")).alias("zcr"), F.count("*").alias("n"))
    return out.where(F.col("n") == size).drop("n")


def speech_threshold(floor: Column) -> Column:
    return F.when(floor > 0.05, floor * 0.75).otherwise(F.least(F.greatest(floor * 2.5, F.lit(0.005)), F.lit(0.05)))


def speech_regions(framed: DataFrame, key: str, frame_ms: int = 30) -> DataFrame:
    """Speech of each key: loud frames with crossings, in runs; short pauses closed, short runs dropped, the rest widened.

    The noise floor is the frame at 15 per cent of the energies' order.
    """
    w = Window.partitionBy(key)
    by_energy = F.row_number().over(w.orderBy("energy", "frame")) - 1
    n = F.count("*").over(w)
    rows = framed.withColumn("rank", by_energy).withColumn("n", n)
    floor = F.max(F.when(F.col("rank") == F.floor(F.col("n") * 15 / 100), F.col("energy"))).over(w)
    rows = rows.withColumn("speech", (F.col("energy") >= speech_threshold(floor)) & (F.col("zcr") > 0.005)).where("speech")
    rows = rows.withColumn("run", F.col("frame") - F.row_number().over(w.orderBy("frame")))
    runs = rows.groupBy(key, "run").agg((F.min("frame") * frame_ms).alias("start_ms"), ((F.max("frame") + 1) * frame_ms).alias("end_ms"), (F.max("n") * frame_ms).alias("total_ms"))
    return merged_intervals(runs, key)


def frame_runs(framed: DataFrame, key: str, active: Column, frame_ms: int, gap_ms: int = 300, least_ms: int = 250) -> DataFrame:
    """Runs of active frames; pauses shorter than ``gap_ms`` closed, runs shorter than ``least_ms`` dropped."""
    w = Window.partitionBy(key).orderBy("frame")
    rows = framed.where(active).withColumn("gap", (F.col("frame") - F.lag("frame").over(w) - 1) * frame_ms)
    rows = rows.withColumn("new", F.when(F.col("gap") < gap_ms, 0).otherwise(1)).withColumn("region", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(key, "region").agg((F.min("frame") * frame_ms).alias("start_ms"), ((F.max("frame") + 1) * frame_ms).alias("end_ms"))
    return out.where(F.col("end_ms") - F.col("start_ms") >= least_ms)


def channel_modes(pairs: DataFrame, key: str) -> DataFrame:
    """separated or mixed for each key's left and right samples (``x``, ``y``): mixed if one is silent or both go together."""
    mx, my = F.avg("x"), F.avg("y")
    n = F.count("*")
    out = pairs.groupBy(key).agg(
        F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("left"), F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("right"),
        (F.sum(F.col("x") * F.col("y")) - n * mx * my).alias("xy"), (F.sum(F.col("x") * F.col("x")) - n * mx * mx).alias("xx"), (F.sum(F.col("y") * F.col("y")) - n * my * my).alias("yy"),
        F.avg(F.abs(F.col("x") - F.col("y"))).alias("apart"),
    )
    scale = F.sqrt(F.greatest(F.col("xx") * F.col("yy"), F.lit(0.0)))
    r = F.when(scale < 1e-6, F.when(F.col("apart") < 1e-4, 1.0).otherwise(0.0)).otherwise(F.greatest(F.least(F.col("xy") / scale, F.lit(1.0)), F.lit(-1.0)))
    mode = F.when((F.col("left") < 0.001) | (F.col("right") < 0.001) | (r > 0.85), "mixed").otherwise("separated")
    return out.select(key, F.round("left", 4).alias("left_rms"), F.round("right", 4).alias("right_rms"), F.round(r, 4).alias("correlation"), mode.alias("mode"))


def mono(samples: Column, channels: int) -> Column:
    """The mean of the channels of interleaved samples."""
    if channels == 1:
        return samples
    n = F.floor(F.size(samples) / channels)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.slice(samples, (i * channels + 1).cast("int"), F.lit(channels)), F.lit(0.0), lambda s, x: s + x) / channels)


def channel(samples: Column, channels: int, which: int) -> Column:
    return F.filter(samples, lambda x, i: i % channels == which)


def time_slice(samples: Column, rate: int, channels: int, start_ms: Column, end_ms: Column) -> Column:
    """The interleaved samples from ``start_ms`` to ``end_ms``, cut at the end; none where these don't follow one another."""
    at = lambda ms: F.least(F.floor(ms * rate / 1000) * channels, F.size(samples)).cast("int")
    return F.when((start_ms >= 0) & (start_ms < end_ms), F.slice(samples, at(start_ms) + 1, at(end_ms) - at(start_ms))).otherwise(F.slice(samples, 1, 0))


def duration_ms(samples: Column, rate: int, channels: int) -> Column:
    """How long interleaved samples last, in whole milliseconds."""
    return F.floor(F.floor(F.size(samples) / channels) * 1000 / rate)


def active_speakers(scores: Column) -> Column:
    """The speakers of the largest of seven classes (none, one of three, two of three); the last of equals."""
    classes = F.array(*[F.array(*[F.lit(s) for s in c]).cast("array<int>") for c in ((), (0,), (1,), (2,), (0, 1), (0, 2), (1, 2))])
    place = F.size(scores) - F.array_position(F.reverse(scores), F.array_max(scores)) + 1
    return F.element_at(classes, place.cast("int"))


def upper_median(x: Column) -> Column:
    """The element at half the length of the sorted values, 1 at least and for none."""
    return F.when(F.size(x) == 0, F.lit(1)).otherwise(F.greatest(F.element_at(F.array_sort(x), (F.floor(F.size(x) / 2) + 1).cast("int")), F.lit(1)))


def mel_filters(bands: int, size: int, rate: int = RATE, low: float = 20.0) -> np.ndarray:
    """Triangles that are evenly spaced in mel, as a (bands, size // 2 + 1) matrix."""
    mel = lambda f: 1127.0 * np.log1p(np.asarray(f) / 700.0)
    edges = 700.0 * np.expm1(np.linspace(mel(low), mel(rate / 2), bands + 2) / 1127.0)
    f = np.arange(size // 2 + 1) * rate / size
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0.0, np.minimum(up, down))


def power_frames(x: np.ndarray, length: int = 400, hop: int = 160, size: int = 512) -> np.ndarray:
    """The power spectra of Hamming frames; a shorter signal is one frame filled up with zeros."""
    x = np.asarray(x, np.float64)
    x = np.pad(x, (0, max(0, length - len(x))))
    at = np.arange(0, len(x) - length + 1, hop)[:, None] + np.arange(length)
    return np.abs(np.fft.rfft(x[at] * np.hamming(length), size)) ** 2


def log_mel(x: np.ndarray, bands: int = 80) -> np.ndarray:
    """Log-mel energies with each band's mean taken off."""
    e = np.log(np.maximum(power_frames(x) @ mel_filters(bands, 512).T, 1e-10))
    return e - e.mean(0)


def pitch(x: np.ndarray, rate: int = RATE, low: int = 70, high: int = 350) -> float | None:
    """The frequency whose lag correlates best, if by more than 0.35."""
    x = np.asarray(x, np.float64) - np.mean(x)
    whole = float(x @ x)
    lags = range(rate // high, min(rate // low, len(x) - 1) + 1)
    if whole < 1e-9 or not lags:
        return None
    r = [float(x[k:] @ x[:-k]) / whole for k in lags]
    best = int(np.argmax(r))
    return rate / lags[best] if r[best] > 0.35 else None


def voice_embedding(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Eighteen cepstral means, pitch and spectral centroid, of length 1."""
    p = power_frames(x)
    e = np.log(np.maximum(p @ mel_filters(20, 512, rate).T, 1e-10)).mean(0)
    k = np.arange(18)[:, None]
    cepstrum = (e * np.cos(np.pi * k * (np.arange(20) + 0.5) / 20)).sum(1)
    f, total = np.arange(257) * rate / 512, p.sum()
    tone = pitch(x[: 4 * 400], rate)
    out = np.concatenate([cepstrum, [0.3 if tone is None else tone / 400.0, float((p * f).sum() / total / 4000.0) if total > 0 else 0.0]])
    n = np.linalg.norm(out)
    return out / n if n > 1e-6 else out


def resampled(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Band-limited resampling in the frequency domain to round(n * to / rate) samples."""
    x = np.asarray(x, np.float64)
    n = round(len(x) * to / rate)
    if not n or rate == to:
        return x[:n]
    spectrum = np.fft.rfft(x)
    out = np.zeros(n // 2 + 1, complex)
    k = min(len(spectrum), len(out))
    out[:k] = spectrum[:k]
    return np.fft.irfft(out, n) * n / len(x)


def wav_bytes(x: np.ndarray, rate: int = RATE, channels: int = 1) -> bytes:
    """16-bit PCM; samples are clamped to -1 to 1."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(x, np.float64), -1, 1) * 32_767).astype("<i2").tobytes())
    return out.getvalue()


def wav_samples(raw: bytes) -> tuple[np.ndarray, int, int]:
    """(interleaved samples, rate, channels) of 8- to 32-bit PCM."""
    with wave.open(io.BytesIO(raw)) as w:
        data, width = w.readframes(w.getnframes()), w.getsampwidth()
        kinds = {1: ("u1", 128.0, 128.0), 2: ("<i2", 0.0, 32_768.0), 4: ("<i4", 0.0, 2_147_483_648.0)}
        kind, zero, scale = kinds[width]
        return (np.frombuffer(data, kind).astype(np.float64) - zero) / scale, w.getframerate(), w.getnchannels()


def is_ogg_opus(raw: bytes) -> bool:
    return raw[:4] == b"OggS" and b"OpusHead" in raw[:128]


def window_embeddings(audio: DataFrame, key: str, samples: str) -> DataFrame:
    """``voice_embedding`` of each row's samples, in Arrow batches."""
    import pandas as pd

    @F.pandas_udf("array<double>")
    def embed(x: pd.Series) -> pd.Series:
        return x.map(lambda v: voice_embedding(np.asarray(v)).tolist())

    return audio.select(key, embed(F.col(samples)).alias("embedding"))


def padded_chunks(rows: DataFrame, samples: str, length: int) -> DataFrame:
    """Signals (call_id and an array of samples) in chunks of ``length``, the last one filled up with zeros; ``real`` says how many are none of these."""
    n = F.size(samples)
    starts = F.sequence(F.lit(1), n, F.lit(length))
    cut = rows.where(n > 0).select("call_id", F.posexplode(F.transform(starts, lambda i: F.slice(samples, i, length))).alias("chunk", "own"))
    return cut.select("call_id", "chunk", F.concat("own", F.array_repeat(F.lit(0.0), length - F.size("own"))).alias("samples"), F.size("own").alias("real"))

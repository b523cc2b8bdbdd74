"""WAV files as chunks of mono samples at one rate, read by Spark's binary file source."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Format tags of the WAV header: integers, floats, and either of them named by a longer header.
_INTEGER, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE
_SCHEMA = pa.schema([("path", pa.string()), ("chunk", pa.int64()), ("samples", pa.list_(pa.float64())), ("error", pa.string())])


def plain_path(path: Column) -> Column:
    """A path without the scheme of local files, as stores hold it."""
    return F.regexp_replace(path, "^file:/*", "/")


def wave_format(content: memoryview) -> tuple[int, int, int, int, memoryview]:
    """(format tag, channels, rate, bits a sample, data) of a WAV file; ValueError where it isn't one that can be read."""
    if len(content) < 12 or bytes(content[:4]) != b"RIFF" or bytes(content[8:12]) != b"WAVE":
        raise ValueError("no WAV file")
    at, found = 12, None
    while at + 8 <= len(content):
        name, n = bytes(content[at : at + 4]), struct.unpack_from("<I", content, at + 4)[0]
        if name == b"fmt " and n >= 16 and at + 24 <= len(content):
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, at + 8)
            if tag == _EXTENSIBLE and n >= 26 and at + 34 <= len(content):
                tag = struct.unpack_from("<H", content, at + 32)[0]
            found = tag, channels, rate, bits
        elif name == b"data":
            if found is None:
                raise ValueError("data without a format")
            tag, channels, rate, bits = found
            if not channels or not rate or (tag, bits) not in {*((_INTEGER, b) for b in (8, 16, 24, 32)), (_FLOAT, 32), (_FLOAT, 64)}:
                raise ValueError(f"format {tag} of {bits} bits, {channels} channels at {rate}")
            return tag, channels, rate, bits, content[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data")


def mono(data: memoryview, tag: int, channels: int, bits: int) -> np.ndarray:
    """The mean of the channels, integers scaled to -1 to 1; an incomplete last sample is left out."""
    width = channels * bits // 8
    data = data[: len(data) // width * width]
    if tag == _FLOAT:
        values = np.frombuffer(data, dtype=f"<f{bits // 8}").astype(float)
    elif bits == 8:
        values = np.frombuffer(data, dtype=np.uint8) / 128.0 - 1
    elif bits == 24:
        wide = np.zeros((len(data) // 3, 4), dtype=np.uint8)
        wide[:, 1:] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3)
        values = wide.view("<i4")[:, 0] / 2.0**31
    else:
        values = np.frombuffer(data, dtype=f"<i{bits // 8}") / 2.0 ** (bits - 1)
    return values.reshape(-1, channels).mean(axis=1)


@lru_cache(maxsize=8)
def _phases(up: int, down: int, lobes: int = 32) -> tuple[np.ndarray, int]:
    """For each of ``up`` phases the weights of the samples around, a low-pass under a Kaiser window; and how many lie before."""
    cut = 0.95 * min(1.0, up / down)
    half = math.ceil(lobes / cut)
    offset = np.arange(-half, half + 1) - np.arange(up)[:, None] / up
    weights = cut * np.sinc(cut * offset) * np.i0(12 * np.sqrt(np.maximum(0, 1 - (offset / (half + 1)) ** 2))) / np.i0(12.0)
    return weights / weights.sum(axis=1, keepdims=True), half


def resampled(samples: np.ndarray, rate: int, to: int, size: int) -> Iterator[np.ndarray]:
    """samples at another rate, size at a time: each output is the sum of the inputs around its time with its phase's weights."""
    up, down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    n = -(-len(samples) * up // down)
    if up == down:
        yield from (samples[at : at + size] for at in range(0, n, size))
        return
    weights, half = _phases(up, down)
    padded = np.concatenate([np.zeros(half), samples, np.zeros(half + 1)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)
    for first in range(0, n, size):
        out = []
        for at in range(first, min(first + size, n), 4096):
            place = np.arange(at, min(at + 4096, first + size, n)) * down
            out.append(np.einsum("ij,ij->i", windows[place // up], weights[place % up]))
        yield np.concatenate(out)


def load_waves(spark: SparkSession, folder: str, size: int = 65536, rate: int = 22050, seconds: float | None = 30.0) -> DataFrame:
    """(path, chunk, samples, error): the WAV files below a folder, as chunks of size samples at one rate, of the first seconds (None: all).

    Integers of 8, 16, 24 and 32 bits and floats, any number of channels (their
    mean). A file that can't be read is one row with its error and no samples;
    a file without samples is one row without either. A task holds one file's
    bytes and, of what it makes of them, one chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda path, chunk, samples, error: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((path, chunk, samples, error), _SCHEMA)], schema=_SCHEMA)
        for b in batches:
            for i in range(b.num_rows):
                path = b.column(0)[i].as_py()
                try:
                    tag, channels, own, bits, data = wave_format(memoryview(b.column(1)[i].as_buffer()))
                    if seconds is not None:
                        data = data[: int(seconds * own) * channels * bits // 8]
                    chunk = -1
                    for chunk, part in enumerate(resampled(mono(data, tag, channels, bits), own, rate, size)):
                        yield row(path, chunk, part, None)
                    if chunk < 0:
                        yield row(path, None, None, None)
                except (ValueError, struct.error) as e:
                    yield row(path, None, None, str(e))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[wW][aA][vV]").load(folder)
    return files.select("path", "content").mapInArrow(run, "path string, chunk long, samples array<double>, error string").withColumn("path", plain_path(F.col("path")))

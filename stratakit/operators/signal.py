"""Signals: windows, spectra, wavelets, rotary positions.

Windows, rotary positions and Haar steps are native; transforms that need complex arithmetic run on Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec


def window_count(length: int, size: int, overlap: int = 0) -> int:
    return 0 if length < size else math.ceil((length - size + 1) / (size - overlap))


def rolling_windows(df: DataFrame, index: str, value: str, size: int, overlap: int = 0, by: list[str] = ()) -> DataFrame:
    """win_idx, samples: full windows over places 0, 1, .. of ``index`` (for each ``by``). Overlap under the size.

    Each row goes to the few windows that hold it; a window's rows meet in one group of bounded size.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and under the size")
    step = size - overlap
    i = F.col(index).cast("long")
    first = F.greatest(F.lit(0), F.ceil((i - size + 1) / step)).cast("long")
    placed = df.select(*by, i.alias("__i"), F.col(value).cast("double").alias("__v"), F.explode(F.sequence(first, F.floor(i / step).cast("long"))).alias("win_idx"))
    placed = placed.where((F.col("__i") >= F.col("win_idx") * step) & (F.col("__i") < F.col("win_idx") * step + size))
    out = placed.groupBy(*by, "win_idx").agg(F.array_sort(F.collect_list(F.struct("__i", "__v"))).alias("s")).where(F.size("s") == size)
    return out.select(*by, "win_idx", F.transform("s", lambda x: x["__v"]).alias("samples"))


def _rows(df: DataFrame, column: str, f, output: str, kind: str, per: int = 1) -> DataFrame:
    """df with ``output``: f of an array column, row by row in Arrow batches; null stays null."""
    names, at = df.columns, df.columns.index(column)
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema)

    def run(batches):
        for batch in batches:
            out = [None if v is None else f(np.array(v, dtype=float)) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind_of)], names=[*names, output])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind_of = to_arrow_type(_parse_datatype_string(kind))
    return df.mapInArrow(run, f"{kinds}, `{output}` {kind}")


COMPLEX = "struct<re:array<double>,im:array<double>>"


def rfft(df: DataFrame, column: str, output: str = "spectrum") -> DataFrame:
    def f(x):
        s = np.fft.rfft(x)
        return {"re": s.real.tolist(), "im": s.imag.tolist()}

    return _rows(df, column, f, output, COMPLEX)


def power_spectrum(df: DataFrame, column: str, output: str = "power") -> DataFrame:
    """ln of the Blackman-windowed magnitude, squared except at both ends."""

    def f(x):
        m = np.abs(np.fft.rfft(x * np.blackman(len(x))))
        m[1:-1] **= 2
        return np.log(m + 1e-12).tolist()

    return _rows(df, column, f, output, "array<double>")


def frequency_fft(df: DataFrame, column: str, output: str = "frequency", windowed: bool = True) -> DataFrame:
    return _rows(df, column, lambda x: np.fft.rfft(x * np.blackman(len(x)) if windowed else x).real.tolist(), output, "array<double>")


def band_gated_fft(df: DataFrame, column: str, gate: list[float], output: str = "gated") -> DataFrame:
    """Back from a spectrum whose bins are weighed by ``gate``; missing bins are 0."""

    def f(x):
        s = np.fft.rfft(x)
        g = np.zeros(len(s))
        g[: min(len(s), len(gate))] = gate[: len(s)]
        return np.fft.irfft(s * g, len(x)).tolist()

    return _rows(df, column, f, output, "array<double>")


def rope(x: Column, position: Column, base: float = 10000.0, inverse: bool = False) -> Column:
    """Rotary embedding of an array of even length: pairs (even, odd) turn by position * base^(-2i/d)."""
    d = F.size(x)
    s = -1.0 if inverse else 1.0

    def turned(v: Column, j: Column) -> Column:
        i = F.floor(j / 2)
        a = position * F.pow(F.lit(base), -2.0 * i / d) * s
        other = F.element_at(x, F.when(j % 2 == 0, j + 2).otherwise(j).cast("int"))
        return F.when(j % 2 == 0, v * F.cos(a) - other * F.sin(a)).otherwise(other * F.sin(a) + v * F.cos(a))

    return F.transform(x, turned)


def haar(x: Column, alpha: float = math.sqrt(0.5), beta: float = math.sqrt(0.5), gamma: float = math.sqrt(0.5), delta: float = -math.sqrt(0.5)) -> Column:
    """struct<approx, detail> of an array of even length."""

    def both(x: Column) -> Column:
        n = (F.size(x) / 2).cast("int")
        places = F.sequence(F.lit(0), n - 1)

        def pair(a: float, b: float) -> Column:
            return F.when(n > 0, F.transform(places, lambda i: F.element_at(x, 2 * i + 1) * a + F.element_at(x, 2 * i + 2) * b)).otherwise(F.array().cast("array<double>"))

        return F.struct(pair(alpha, beta).alias("approx"), pair(gamma, delta).alias("detail"))

    return vec.bound(x, both)


def haar_multiscale(x: Column, scales: int) -> Column:
    """struct<approx, details>: details of each scale, the finest first."""
    out = F.struct(x.alias("approx"), F.array().cast("array<array<double>>").alias("details"))
    for _ in range(scales):
        # each scale is computed once, from the one before
        out = vec.bound(out, lambda s: vec.bound(haar(s["approx"]), lambda h: F.struct(h["approx"].alias("approx"), F.concat(s["details"], F.array(h["detail"])).alias("details"))))
    return out


#: Filters of the orthogonal wavelets with one and two vanishing moments.
FILTERS = {
    "haar": [math.sqrt(0.5), math.sqrt(0.5)],
    "db2": [(1 + math.sqrt(3)) / (4 * math.sqrt(2)), (3 + math.sqrt(3)) / (4 * math.sqrt(2)), (3 - math.sqrt(3)) / (4 * math.sqrt(2)), (1 - math.sqrt(3)) / (4 * math.sqrt(2))],
}


def _bank(name: str) -> tuple[np.ndarray, np.ndarray]:
    low = np.array(FILTERS[name])
    return low, low[::-1] * (-1.0) ** np.arange(len(low))


def dwt(x: np.ndarray, wavelet: str = "haar") -> tuple[np.ndarray, np.ndarray]:
    """One periodic level along the last axis, which has even length: approximation and detail."""
    low, high = _bank(wavelet)
    n = x.shape[-1]
    at = (np.arange(0, n, 2)[:, None] + np.arange(len(low))) % n
    return x[..., at] @ low, x[..., at] @ high


def idwt(a: np.ndarray, d: np.ndarray, wavelet: str = "haar") -> np.ndarray:
    low, high = _bank(wavelet)
    n = 2 * a.shape[-1]
    out = np.zeros((*a.shape[:-1], n))
    for k in range(len(low)):
        at = (np.arange(0, n, 2) + k) % n
        out[..., at] += a * low[k] + d * high[k]
    return out


def dwt_nd(x: np.ndarray, wavelet: str = "haar", axis: int = -1):
    a, d = dwt(np.moveaxis(x, axis, -1), wavelet)
    return np.moveaxis(a, -1, axis), np.moveaxis(d, -1, axis)


def idwt_nd(a: np.ndarray, d: np.ndarray, wavelet: str = "haar", axis: int = -1) -> np.ndarray:
    return np.moveaxis(idwt(np.moveaxis(a, axis, -1), np.moveaxis(d, axis, -1), wavelet), -1, axis)


def wpt(x: np.ndarray, level: int, wavelet: str = "haar") -> np.ndarray:
    """Wavelet packets: the blocks of the full binary tree, one after the other, along the last axis."""
    blocks = [x]
    for _ in range(level):
        blocks = [half for b in blocks for half in dwt(b, wavelet)]
    return np.concatenate(blocks, axis=-1)


def iwpt(x: np.ndarray, level: int, wavelet: str = "haar") -> np.ndarray:
    blocks = np.split(x, 2**level, axis=-1)
    for _ in range(level):
        blocks = [idwt(blocks[i], blocks[i + 1], wavelet) for i in range(0, len(blocks), 2)]
    return blocks[0]


def wpt_bins(x: np.ndarray, level: int) -> np.ndarray:
    return x.reshape(*x.shape[:-1], 2**level, -1)


def wavelet_packets(df: DataFrame, column: str, level: int, wavelet: str = "haar", output: str = "packets", inverse: bool = False) -> DataFrame:
    f = iwpt if inverse else wpt
    return _rows(df, column, lambda x: f(x, level, wavelet).tolist(), output, "array<double>")


def discrete_wavelet(df: DataFrame, column: str, wavelet: str = "haar", output: str = "dwt") -> DataFrame:
    def f(x):
        a, d = dwt(x, wavelet)
        return {"approx": a.tolist(), "detail": d.tolist()}

    return _rows(df, column, f, output, "struct<approx:array<double>,detail:array<double>>")


def morlet_length(frequency: float, rate: float, width: float) -> int:
    return 2 * int(3.5 * width / (2 * math.pi * frequency) * rate) + 1


def morlet(frequency: float, rate: float, width: float) -> np.ndarray:
    """A exp(-t^2 / 2 s^2) exp(2 pi i f t), s = width / (2 pi f), A = 1 / sqrt(s sqrt(2 pi)), up to 3.5 s."""
    s = width / (2 * math.pi * frequency)
    half = int(3.5 * s * rate)
    t = np.arange(-half, half + 1) / rate
    return np.exp(-(t**2) / (2 * s**2)) * np.exp(2j * math.pi * frequency * t) / math.sqrt(s * math.sqrt(2 * math.pi))


def energy_phase(x: np.ndarray, frequency: float, rate: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Squared modulus and phase in degrees of x with a Morlet wavelet, as long as x."""
    m = morlet(frequency, rate, width)
    n = len(x) + len(m) - 1
    y = np.fft.ifft(np.fft.fft(x, n) * np.fft.fft(m, n))
    start = (len(m) - 1) // 2
    y = y[start : start + len(x)]
    return np.abs(y) ** 2, np.degrees(np.angle(y))


def cwt(df: DataFrame, column: str, frequencies: list[float], rate: float, width: float = 7.0, output: str = "cwt") -> DataFrame:
    """struct<energy, phase>, each an array by frequency of arrays by time."""

    def f(x):
        both = [energy_phase(x, q, rate, width) for q in frequencies]
        return {"energy": [e.tolist() for e, _ in both], "phase": [p.tolist() for _, p in both]}

    return _rows(df, column, f, output, "struct<energy:array<array<double>>,phase:array<array<double>>>")

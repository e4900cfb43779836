"""Layer networks: parameters on the driver, forward passes over rows in Arrow batches, gradients as partial sums.

A layer's forward and backward take arrays of (batch, .., features). Training sums gradients over all rows of a
DataFrame, one pass a step.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-14


def _sigmoid(x):
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


#: name: function of the input, derivative by input and output.
ACTIVATIONS: dict[str, tuple[Callable, Callable]] = {
    "linear": (lambda x: x, lambda x, y: np.ones_like(x)),
    "sigmoid": (_sigmoid, lambda x, y: y * (1 - y)),
    "tanh": (np.tanh, lambda x, y: 1 - y * y),
    "relu": (lambda x: np.maximum(x, 0), lambda x, y: (x >= 0).astype(float)),
    "relu_leaky": (lambda x: np.where(x > 0, x, 0.1 * x), lambda x, y: np.where(x > 0, 1.0, 0.1)),
    "swish": (lambda x: x * _sigmoid(x), lambda x, y: _sigmoid(x) + x * _sigmoid(x) * (1 - _sigmoid(x))),
}


def xavier(rng: np.random.Generator, ni: int, no: int) -> np.ndarray:
    return rng.normal(0, 1 / np.sqrt(ni), (ni, no))


def kaiming(rng: np.random.Generator, ni: int, no: int) -> np.ndarray:
    return rng.normal(0, np.sqrt(2 / ni), (ni, no))


WEIGHT_INIT = {"linear": xavier, "sigmoid": xavier, "tanh": xavier, "relu": kaiming, "relu_leaky": kaiming, "swish": kaiming}


class Layer(ABC):
    """params and grads share their keys; grads are of the last backward pass."""

    def __init__(self):
        self.params: dict[str, np.ndarray] = {}
        self.grads: dict[str, np.ndarray] = {}
        self.training = False

    @abstractmethod
    def forward(self, x: np.ndarray) -> np.ndarray: ...

    @abstractmethod
    def backward(self, delta: np.ndarray) -> np.ndarray: ...

    def update(self, optimizer: Optimizer) -> None:
        optimizer.step(self)

    def purge(self) -> None:
        self.x = self.y = None

    def zero_gradients(self) -> None:
        self.grads = {k: np.zeros_like(v) for k, v in self.params.items()}

    @property
    def num_parameters(self) -> int:
        return sum(v.size for v in self.params.values())

    def get_weights(self) -> dict[str, np.ndarray]:
        return dict(self.params)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)


class Dense(Layer):
    """act(x W + b) on the last axis; gradients are means over the leading axis."""

    def __init__(self, ni: int, no: int, activation: str = "linear", seed: int = 42):
        super().__init__()
        self.activation = activation
        self.params = {"w": WEIGHT_INIT[activation](np.random.default_rng(seed), ni, no), "b": np.zeros(no)}

    def forward(self, x):
        if x.shape[-1] != self.params["w"].shape[0]:
            raise ValueError(f"expects {self.params['w'].shape[0]} features, got {x.shape[-1]}")
        self.x = x
        self.z = x @ self.params["w"] + self.params["b"]
        self.y = ACTIVATIONS[self.activation][0](self.z)
        return self.y

    def backward(self, delta):
        delta = delta * ACTIVATIONS[self.activation][1](self.z, self.y)
        n = delta.shape[0] + EPS
        flat, x = delta.reshape(-1, delta.shape[-1]), self.x.reshape(-1, self.x.shape[-1])
        self.grads = {"w": x.T @ flat / n, "b": flat.sum(axis=0) / n}
        return delta @ self.params["w"].T


class Dropout(Layer):
    """In training each element is 0 with chance p; ``rescale`` divides the others by 1 - p."""

    def __init__(self, p: float = 0.05, rescale: bool = True, seed: int = 42):
        super().__init__()
        self.p, self.rescale, self.rng = p, rescale, np.random.default_rng(seed)

    def forward(self, x):
        self.mask = np.ones_like(x)
        if self.training and self.p > 0:
            self.mask = (self.rng.random(x.shape) >= self.p) / ((1 - self.p) if self.rescale else 1.0)
        return x * self.mask

    def backward(self, delta):
        return delta * self.mask


class Normalize(Layer):
    """Layer norm over the last axis, with a scale and shift if asked for."""

    def __init__(self, ni: int, shift_scale: bool = False, eps: float = 1e-5):
        super().__init__()
        self.eps = eps
        if shift_scale:
            self.params = {"gamma": np.full(ni, 0.01), "beta": np.full(ni, 0.01)}

    def forward(self, x):
        self.std = np.sqrt(x.var(axis=-1, keepdims=True) + self.eps)
        self.xhat = (x - x.mean(axis=-1, keepdims=True)) / self.std
        return self.xhat * self.params["gamma"] + self.params["beta"] if self.params else self.xhat

    def backward(self, delta):
        if self.params:
            n, axes = delta.shape[0] + EPS, tuple(range(delta.ndim - 1))
            self.grads = {"gamma": (delta * self.xhat).sum(axis=axes) / n, "beta": delta.sum(axis=axes) / n}
            delta = delta * self.params["gamma"]
        return (delta - delta.mean(axis=-1, keepdims=True) - self.xhat * (delta * self.xhat).mean(axis=-1, keepdims=True)) / self.std


class FrequencyFFT(Layer):
    """Real part of the windowed rfft of the last axis; backwards by its transpose."""

    def __init__(self, max_len: int, window: bool = True):
        super().__init__()
        w = np.blackman(max_len) if window else np.ones(max_len)
        k = np.arange(max_len // 2 + 1)
        self.matrix = w[:, None] * np.cos(2 * np.pi * np.outer(np.arange(max_len), k) / max_len)

    def forward(self, x):
        return x @ self.matrix

    def backward(self, delta):
        return delta @ self.matrix.T


class Fourier(Layer):
    """Real part of the FFT over the last two axes, or over the last."""

    def __init__(self, use_2d: bool = True):
        super().__init__()
        self.use_2d = use_2d

    def forward(self, x):
        return np.fft.fft2(x).real if self.use_2d else np.fft.fft(x).real

    # the real part of a discrete Fourier transform is a symmetric matrix
    backward = forward


class InverseFourier(Fourier):
    def forward(self, x):
        return np.fft.ifft2(x).real if self.use_2d else np.fft.ifft(x).real

    backward = forward


class Rope(Layer):
    """Rotary positions on (.., sequence, dim)."""

    def __init__(self, seq_len: int, dim: int, base: float = 10000.0):
        super().__init__()
        self.angle = np.arange(seq_len)[:, None] * base ** (-2 * np.arange(dim // 2) / dim)

    def _turn(self, x, a):
        out = np.empty_like(x)
        c, s = np.cos(a), np.sin(a)
        out[..., 0::2] = x[..., 0::2] * c - x[..., 1::2] * s
        out[..., 1::2] = x[..., 0::2] * s + x[..., 1::2] * c
        return out

    def forward(self, x):
        return self._turn(x, self.angle[: x.shape[-2]])

    def backward(self, delta):
        return self._turn(delta, -self.angle[: delta.shape[-2]])


class LatentStack(Layer):
    """Two inputs side by side on the last axis."""

    def forward(self, x, other=None):
        a, b = x if other is None else (x, other)
        self.cut = a.shape[-1]
        return np.concatenate([a, b], axis=-1)

    def backward(self, delta):
        return delta[..., : self.cut], delta[..., self.cut :]


class Embedding(Layer):
    """Rows of a table by integer code; gradients are scattered back."""

    def __init__(self, size: int, dim: int, seed: int = 42):
        super().__init__()
        self.params = {"table": np.random.default_rng(seed).normal(0, 1 / np.sqrt(dim), (size, dim))}

    def forward(self, x):
        self.x = x
        return self.params["table"][x]

    def backward(self, delta):
        g = np.zeros_like(self.params["table"])
        np.add.at(g, self.x, delta)
        self.grads = {"table": g / (delta.shape[0] + EPS)}
        return np.zeros(self.x.shape)


class Block(Layer):
    """Layers of its own; their parameters count as the block's."""

    parts: list[Layer]

    @property
    def num_parameters(self) -> int:
        return sum(p.num_parameters for p in self.parts)

    def update(self, optimizer):
        for p in self.parts:
            p.update(optimizer)

    def zero_gradients(self):
        for p in self.parts:
            p.zero_gradients()


class FourierAttention(Block):
    """u = norm(x + Re FFT(x)); norm(relu(u W + b) + u)."""

    def __init__(self, n: int, use_2d: bool = True, seed: int = 42):
        super().__init__()
        self.mix, self.first, self.dense, self.last = Fourier(use_2d), Normalize(n), Dense(n, n, "relu", seed), Normalize(n, True)
        self.parts = [self.mix, self.first, self.dense, self.last]

    def forward(self, x):
        u = self.first(x + self.mix(x))
        return self.last(self.dense(u) + u)

    def backward(self, delta):
        delta = self.last.backward(delta)
        delta = self.first.backward(delta + self.dense.backward(delta))
        return delta + self.mix.backward(delta)


class SpectreAttention(Block):
    """Values' spectrum over the sequence, gated by a network of the mean query; phase by position.

    Forward only is exact; backward passes gradients through the values with the gate held fixed.
    """

    def __init__(self, seq: int, hidden: int, seed: int = 42, bias: float = -0.1):
        super().__init__()
        self.seq, self.bias, bins = seq, bias, seq // 2 + 1
        self.query, self.value = Dense(hidden, hidden, "linear", seed), Dense(hidden, hidden, "linear", seed + 1)
        self.inner, self.outer = Dense(hidden, hidden, "relu", seed + 2), Dense(hidden, 2 * bins, "linear", seed + 3)
        self.parts = [self.query, self.value, self.inner, self.outer]
        self.phase = np.exp(2j * np.pi * np.arange(bins) / seq)

    def forward(self, x):
        spectrum = np.fft.rfft(self.value(x), axis=-2)
        q = self.query(x).mean(axis=-2)
        h = (q - q.mean()) / (q.std() + 1e-5)
        re, im = np.split(self.outer(self.inner(h)), 2, axis=-1)
        z = re + 1j * im
        size = np.abs(z)
        self.gate = (np.where(size > 0, z / np.where(size > 0, size, 1), 0) * np.maximum(size + self.bias, 0) * self.phase)[..., None]
        return np.fft.irfft(spectrum * self.gate, n=self.seq, axis=-2) / self.seq

    def backward(self, delta):
        # the transpose of irfft(gate * rfft(.)) filters with the gate's conjugate
        back = np.fft.irfft(np.fft.rfft(delta, axis=-2) * np.conj(self.gate), n=self.seq, axis=-2) / self.seq
        return self.value.backward(back)


class VotingGate(Block):
    """A softmax over experts weighs their outputs."""

    def __init__(self, ni: int, no: int, experts: int, activation: str = "relu", seed: int = 42):
        super().__init__()
        self.experts = [Dense(ni, no, activation, seed + i) for i in range(experts)]
        self.vote = Dense(ni, experts, "linear", seed + experts)
        self.parts = [*self.experts, self.vote]

    def forward(self, x):
        z = self.vote(x)
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        self.p = e / e.sum(axis=-1, keepdims=True)
        self.outs = np.stack([m(x) for m in self.experts], axis=-1)
        return (self.outs * self.p[..., None, :]).sum(axis=-1)

    def backward(self, delta):
        dp = (delta[..., None] * self.outs).sum(axis=-2)
        dz = self.p * (dp - (dp * self.p).sum(axis=-1, keepdims=True))
        return self.vote.backward(dz) + sum(m.backward(delta * self.p[..., i : i + 1]) for i, m in enumerate(self.experts))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list array, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Optimizer(ABC):
    def __init__(self, lr: float = 0.001):
        self.lr = lr

    @abstractmethod
    def step(self, layer: Layer) -> None: ...


class SGD(Optimizer):
    """``clip``: the greatest norm of a layer's gradient."""

    def __init__(self, lr: float = 0.001, clip: float | None = None):
        super().__init__(lr)
        self.clip = clip

    def step(self, layer):
        k = 1.0
        if self.clip and layer.grads:
            size = np.sqrt(sum(float((g**2).sum()) for g in layer.grads.values()))
            k = min(1.0, self.clip / size) if size > 0 else 1.0
        for name, g in layer.grads.items():
            layer.params[name] = layer.params[name] - self.lr * k * g


class NeuralNetwork:
    def __init__(self, layers: list[Layer]):
        self.layers = layers

    def forward(self, x: np.ndarray, training: bool = False) -> np.ndarray:
        for layer in self.layers:
            layer.training = training
            x = layer.forward(x)
        return x

    __call__ = forward

    def backward(self, delta: np.ndarray) -> np.ndarray:
        for layer in reversed(self.layers):
            delta = layer.backward(delta)
        return delta

    @property
    def num_parameters(self) -> int:
        return sum(layer.num_parameters for layer in self.layers)

    def _leaves(self) -> list[Layer]:
        out, todo = [], list(self.layers)
        while todo:
            layer = todo.pop(0)
            todo = [*layer.parts, *todo] if isinstance(layer, Block) else todo
            out += [layer] if layer.params else []
        return out

    def predict(self, df: DataFrame, features: str, output: str = "prediction") -> DataFrame:
        """df with the output array of every row's feature array."""
        net, names, at = self, df.columns, df.columns.index(features)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

        def run(batches):
            for batch in batches:
                x = matrix(batch.column(at))
                y = net.forward(x).tolist() if len(batch) else []
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y, pa.list_(pa.float64()))], names=[*names, output])

        return df.mapInArrow(run, f"{kinds}, `{output}` array<double>")

    def fit(self, df: DataFrame, features: str, target: str, epochs: int = 50, optimizer: Optimizer | None = None) -> list[float]:
        """Full-batch squared-error training: each epoch is one pass of summed gradients. Returns the losses."""
        optimizer = optimizer or SGD()
        rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y")).where("x is not null and y is not null").cache()
        losses = []
        for _ in range(epochs):
            net = self

            def run(batches, net=net):
                n, loss, total = 0, 0.0, None
                for batch in batches:
                    if not len(batch):
                        continue
                    x, y = matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)[:, None]
                    d = net.forward(x, True) - y
                    net.backward(2 * d)
                    g = np.concatenate([layer.grads[k].ravel() for layer in net._leaves() for k in layer.params]) * len(x)
                    n, loss, total = n + len(x), loss + float((d**2).sum()), g if total is None else total + g
                if n:
                    yield pa.RecordBatch.from_pydict({"m": [np.r_[n, loss, total].tolist()]})

            s = rows.mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
            if not len(s):
                break
            losses.append(float(s[1] / s[0]))
            grad, at = s[2:] / s[0], 0
            for layer in self._leaves():
                for k, v in layer.params.items():
                    layer.grads[k] = grad[at : at + v.size].reshape(v.shape)
                    at += v.size
                optimizer.step(layer)
        rows.unpersist()
        return losses

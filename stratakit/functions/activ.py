"""Activations and their derivatives as Column functions, with registries that users extend."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vec

ACTIVATIONS: dict[str, Callable] = {}
DERIVATIVES: dict[str, Callable] = {}


def activation(f: Callable) -> Callable:
    """Registers a function under its name."""
    ACTIVATIONS[f.__name__] = f
    return f


def derivative(of: str) -> Callable:
    def add(f: Callable) -> Callable:
        DERIVATIVES[of] = f
        return f

    return add


@activation
def linear(x: Column) -> Column:
    return x


@activation
def sigmoid(x: Column) -> Column:
    """Stable for large |x|: each branch only exponentiates a negative number."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


@activation
def swish(x: Column) -> Column:
    return x * sigmoid(x)


@activation
def tanh(x: Column) -> Column:
    return F.tanh(x)


@activation
def relu(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


@activation
def relu_leaky(x: Column, alpha: float = 0.1) -> Column:
    return F.when(x > 0, x).otherwise(alpha * x)


@activation
def mod_relu(x: Column, bias: float = -0.2) -> Column:
    """Shrinks the modulus by -bias and keeps the sign; 0 at 0."""
    return F.signum(x) * F.greatest(F.abs(x) + bias, F.lit(0.0))


def mod_relu_complex(z: Column, bias: float = -0.2) -> Column:
    """z: struct<re, im>."""
    size = F.sqrt(z["re"] * z["re"] + z["im"] * z["im"])
    k = F.when(size > 0, F.greatest(size + bias, F.lit(0.0)) / F.when(size > 0, size)).otherwise(0.0)
    return F.struct((z["re"] * k).alias("re"), (z["im"] * k).alias("im"))


@activation
def softmax(a: Column) -> Column:
    """a: array<double>."""
    powers = vec.bound(a, lambda v: vec.bound(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
    return vec.bound(powers, lambda e: vec.bound(vec.total(e), lambda s: F.transform(e, lambda x: x / s)))


@derivative("linear")
def linear_derivative(g: Column) -> Column:
    return F.when(g.isNotNull(), F.lit(1.0))


@derivative("sigmoid")
def sigmoid_derivative(out: Column, compat: bool = False) -> Column:
    """By the activation's output; ``compat`` applies the sigmoid once more first."""
    s = sigmoid(out) if compat else out
    return s * (1 - s)


@derivative("tanh")
def tanh_derivative(out: Column) -> Column:
    return 1 - out * out


@derivative("relu")
def relu_derivative(x: Column) -> Column:
    """1 at 0."""
    return F.when(x < 0, 0.0).when(x.isNotNull(), 1.0)


@derivative("relu_leaky")
def relu_leaky_derivative(x: Column, alpha: float = 0.1, compat: bool = False) -> Column:
    return F.when(x.isNotNull(), F.lit(1.0)) if compat else F.when(x > 0, 1.0).when(x.isNotNull(), alpha)


@derivative("swish")
def swish_derivative(x: Column) -> Column:
    s = sigmoid(x)
    return s + x * s * (1 - s)


@derivative("softmax")
def softmax_derivative(p: Column) -> Column:
    """The Jacobian diag(p) - p p', an array of rows."""
    return F.transform(p, lambda x, i: F.transform(p, lambda y, j: F.when(i == j, x).otherwise(0.0) - x * y))


@derivative("mod_relu")
def mod_relu_derivative(z: Column, upstream: Column, bias: float = -0.2, eps: float = 1e-12) -> Column:
    """struct<d_bias, d_z> for real z: where the shrunken modulus is positive the sign and 1, else 0."""
    alive = F.abs(z) + bias > 0
    return F.struct(F.when(alive, upstream * z / (F.abs(z) + eps)).otherwise(0.0).alias("d_bias"), F.when(alive, upstream).otherwise(0.0).alias("d_z"))

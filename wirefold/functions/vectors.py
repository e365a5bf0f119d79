"""Array-column operators (convolution, pooling, softmax, argmax, loss).

Column functions over ``ARRAY<DOUBLE>``. Every lambda reads only its own
arguments: strided taps are built as ``filter(slice(a, ...), (x, i) -> i % s = 0)``
arrays and combined with ``zip_with``, so Catalyst never re-evaluates the
input array once per output element.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double_array(a: str) -> Column:
    return F.expr(f"transform({a}, x -> CAST(x AS DOUBLE))")


def vectorize(a: str) -> Column:
    """V1: array -> ML dense vector."""
    return array_to_vector(F.col(a))


def devectorize(v: str) -> Column:
    return vector_to_array(F.col(v))


def _taps(a: str, k: int, stride: int, m: str) -> list[str]:
    """For each kernel tap j: the m inputs a[i*stride + j], i = 0..m-1."""
    return [f"filter(slice({a}, {j + 1}, ({m} - 1) * {stride} + 1), (x, i) -> i % {stride} = 0)" for j in range(k)]


def _combine(arrays: list[str], weights: list[float] | None, op: str) -> str:
    """Element-wise weighted sum (op='sum') or max (op='max') of equal-length arrays."""
    w = weights or [1.0] * len(arrays)
    if op == "sum":
        acc = f"transform({arrays[0]}, x -> x * {float(w[0])}D)"
        for arr, wj in zip(arrays[1:], w[1:]):
            acc = f"zip_with({acc}, {arr}, (s, x) -> s + x * {float(wj)}D)"
        return acc
    acc = arrays[0]
    for arr in arrays[1:]:
        acc = f"zip_with({acc}, {arr}, (s, x) -> greatest(s, x))"
    return acc


def _conv_sql(a: str, kernel: list[float], stride: int, relu: bool, bias: float = 0.0) -> str:
    k = len(kernel)
    m = f"(CAST((size({a}) - {k}) / {stride} AS INT) + 1)"
    acc = _combine(_taps(a, k, stride, m), kernel, "sum")
    body = f"greatest(0D, s + {float(bias)}D)" if relu else f"s + {float(bias)}D"
    return f"CASE WHEN size({a}) >= {k} THEN transform({acc}, s -> {body}) ELSE array() END"


def _same_pad_sql(a: str, k: int, stride: int) -> str:
    n = f"size({a})"
    p = f"greatest(0, (CAST(({n} + {stride} - 1) / {stride} AS INT) - 1) * {stride} + {k} - {n})"
    return f"concat(array_repeat(0D, CAST({p} / 2 AS INT)), {a}, array_repeat(0D, {p} - CAST({p} / 2 AS INT)))"


def _pool_sql(a: str, k: int) -> str:
    m = f"CAST(size({a}) / {k} AS INT)"
    return f"CASE WHEN size({a}) >= {k} THEN {_combine(_taps(a, k, k, m), None, 'max')} ELSE array() END"


def _let(value_sql: str, var: str, body_sql: str) -> str:
    """Evaluate ``value_sql`` once and bind it to lambda variable ``var`` inside ``body_sql``."""
    return f"aggregate(array(1), {value_sql}, ({var}, _u) -> {var}, {var} -> {body_sql})"


def conv1d(a: str, kernel: list[float], stride: int = 1, relu: bool = True, bias: float = 0.0) -> Column:
    """V2: valid 1-D convolution (cross-correlation) of one channel, then ReLU."""
    return F.expr(_conv_sql(a, kernel, stride, relu, bias))


def same_pad(a: str, k: int, stride: int) -> Column:
    """SAME padding: out = ceil(n/s), p = max(0, (out-1)*s + k - n), p//2 zeros on the left."""
    return F.expr(_same_pad_sql(a, k, stride))


def conv1d_same(a: str, kernel: list[float], stride: int = 1, relu: bool = True) -> Column:
    """V3: SAME-padded convolution (the padded array is built once)."""
    return F.expr(_let(_same_pad_sql(a, len(kernel), stride), "p", _conv_sql("p", kernel, stride, relu)))


def max_pool1d(a: str, k: int = 2) -> Column:
    """V4: window k, stride k, tail dropped."""
    return F.expr(_pool_sql(a, k))


def max_pool1d_same(a: str, k: int = 2) -> Column:
    """V4 SAME variant: zero padding by the stride-1 formula, then pooling with stride = k."""
    return F.expr(_let(_same_pad_sql(a, k, 1), "p", _pool_sql("p", k)))


def global_mean_pool(a: str) -> Column:
    """V5: mean over positions."""
    return F.expr(f"aggregate({a}, 0D, (s, x) -> s + x) / size({a})")


def shortcut_add(a: str, b: str) -> Column:
    """V6: a + b, the shorter b zero-padded symmetrically (extra zero on the right)."""
    d = f"(size({a}) - size({b}))"
    padded = f"concat(array_repeat(0D, CAST({d} / 2 AS INT)), {b}, array_repeat(0D, {d} - CAST({d} / 2 AS INT)))"
    return F.expr(f"zip_with({a}, {padded}, (x, y) -> x + y)")


def log_softmax(a: str) -> Column:
    """V7: a - max - ln(sum(exp(a - max)))."""
    lse = "ln(aggregate(z, 0D, (s, y) -> s + exp(y - mx)))"
    return F.expr(_let(a, "z", _let("array_max(z)", "mx", _let(lse, "lse", "transform(z, x -> x - mx - lse)"))))


def argmax(a: str) -> Column:
    """V7: 0-based index of the first maximum."""
    return F.expr(f"CAST(array_position({a}, array_max({a})) - 1 AS INT)")


def nll(logp: str, label: str) -> Column:
    """V13 (per row): negative log-likelihood of the true class."""
    return F.expr(f"-element_at({logp}, CAST({label} AS INT) + 1)")

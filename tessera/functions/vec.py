"""Vector arithmetic as column expressions on array<double>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value bound, so that it is evaluated once a row and not wherever a lambda names it."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def angular(a: Column, b: Column) -> Column:
    """1 - cosine, 0 to 2: the neighbour search's distance."""
    return 1 - cosine(a, b)


def angular_pi(a: Column, b: Column) -> Column:
    """Angle over pi, 0 to 1: the distance of paths and compositions."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))) / math.pi


def similarity(metric: str, d: Column) -> Column:
    return {"euclidean": 1 / (1 + d), "dot": -d}.get(metric, 1 - d)


def distance(metric: str, a: Column, b: Column) -> Column:
    return {"euclidean": lambda: euclid(a, b), "dot": lambda: -dot(a, b), "angular": lambda: angular(a, b)}[metric]()


def literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def quantize(a: Column) -> Column:
    """Unit components to whole numbers of -127 to 127, half to even."""
    return F.transform(a, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(x * 127).cast("int"))))


def dequantize(a: Column) -> Column:
    return F.transform(a, lambda x: x / F.lit(127.0))


def unit(a: Column) -> Column:
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))


def poincare(a: Column, scale: Column) -> Column:
    """Direction kept, length tanh(|a| / (2 scale)): into the unit ball."""
    grown = lambda n: let(F.tanh(n / (2 * scale)) / n, lambda f: F.transform(a, lambda x: x * f))
    return let(norm(a), lambda n: F.when(n > 0, grown(n)).otherwise(a))


def hyperbolic(a: Column, b: Column) -> Column:
    """Distance in the Poincare ball."""
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.acosh(1 + 2 * gap / ((1 - dot(a, a)) * (1 - dot(b, b))))


def finite(a: Column) -> Column:
    return a.isNotNull() & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def softmax(a: Column, temperature: float) -> Column:
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, y: s + y)
    share = lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t))
    return let(F.array_max(a), lambda top: let(F.transform(a, lambda x: F.exp((x - top) / temperature)), share))


def sign_bits(a: Column, word: int = 64) -> Column:
    """For each component whether it is above the vector's mean, as bigints of ``word`` bits, the first component the lowest bit of the first."""
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    ones = lambda m: F.transform(a, lambda x, k: F.when(x > m, F.call_function("shiftleft", F.lit(1).cast("long"), k % word)).otherwise(F.lit(0).cast("long")))
    words = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / word).cast("int"))
    fold = lambda bits: F.transform(words, lambda w: F.aggregate(F.slice(bits, w * word + 1, word), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x)))
    return let(mean, lambda m: let(ones(m), fold))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def best_aligned(a: Column, b: Column, reach: int, least: int) -> Column:
    """The best share of equal places of two arrays over shifts of up to ``reach``, with ``least`` places in common; null if there are none."""

    def share(shift):
        x = F.slice(a, max(1, 1 - shift), F.greatest(F.lit(0), F.size(a)))
        y = F.slice(b, max(1, 1 + shift), F.greatest(F.lit(0), F.size(b)))
        n = F.least(F.size(x), F.size(y))
        same = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
        return F.when(n >= least, same / n)

    return F.array_max(F.array(*[share(k) for k in range(-reach, reach + 1)]))

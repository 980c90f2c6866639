"""The functions of expressions, by name."""

from __future__ import annotations

import math as m
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _vector(f: Callable[[float], float]) -> Callable[[Column], Column]:
    """Functions that Spark lacks, over Arrow batches."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or v != v and v is None else f(v) if v == v else m.nan)

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return lambda x: F.pandas_udf(run, DoubleType())(x.cast("double"))


def _lgamma(v: float) -> float:
    try:
        return m.lgamma(v)
    except ValueError:
        return m.inf
    except OverflowError:
        return m.inf


def _trunc(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")


def _rotl(x: Column, n: Column) -> Column:
    n = F.pmod(n.cast("int"), F.lit(64))
    return F.call_function("shiftleft", x.cast("long"), n).bitwiseOR(F.when(n == 0, F.lit(0)).otherwise(F.call_function("shiftrightunsigned", x.cast("long"), 64 - n)))


def _bits(x: Column) -> Column:
    return F.bin(x.cast("long"))


erf, erfc, lgamma = _vector(m.erf), _vector(m.erfc), _vector(_lgamma)
INF = float("inf")

#: name -> (arities, kind of the result, function)
TABLE: dict[str, tuple[tuple[int, ...], str, Callable[..., Column]]] = {
    "abs": ((1,), "same", F.abs),
    "sqrt": ((1,), "float", F.sqrt),
    "rsqrt": ((1,), "float", lambda x: F.pow(x, F.lit(-0.5))),
    "cbrt": ((1,), "float", F.cbrt),
    "pow": ((2,), "float", F.pow),
    "hypot": ((2,), "float", F.hypot),
    "lerp": ((3,), "float", lambda a, b, t: a + (b - a) * t),
    "exp": ((1,), "float", F.exp),
    "exp2": ((1,), "float", lambda x: F.pow(F.lit(2.0), x)),
    "exp10": ((1,), "float", lambda x: F.pow(F.lit(10.0), x)),
    "expm1": ((1,), "float", F.expm1),
    "log": ((1,), "float", F.ln),
    "log2": ((1,), "float", F.log2),
    "log10": ((1,), "float", F.log10),
    "log1p": ((1,), "float", F.log1p),
    "sin": ((1,), "float", F.sin),
    "cos": ((1,), "float", F.cos),
    "tan": ((1,), "float", F.tan),
    "asin": ((1,), "float", F.asin),
    "acos": ((1,), "float", F.acos),
    "atan": ((1,), "float", F.atan),
    "atan2": ((2,), "float", F.atan2),
    "sinc": ((1,), "float", lambda x: F.when(x == 0, F.lit(1.0)).otherwise(F.sin(x) / x)),
    "sinh": ((1,), "float", F.sinh),
    "cosh": ((1,), "float", F.cosh),
    "tanh": ((1,), "float", F.tanh),
    "asinh": ((1,), "float", F.asinh),
    "acosh": ((1,), "float", F.acosh),
    "atanh": ((1,), "float", F.atanh),
    "floor": ((1,), "float", lambda x: F.floor(x).cast("double")),
    "ceil": ((1,), "float", lambda x: F.ceil(x).cast("double")),
    "trunc": ((1,), "float", _trunc),
    "round": ((1,), "float", lambda x: F.floor(x + 0.5).cast("double")),
    "clamp": ((3,), "float", lambda x, lo, hi: F.least(F.greatest(x, lo), hi)),
    "copysign": ((2,), "float", lambda x, s: F.when(s < 0, -F.abs(x)).otherwise(F.abs(x))),
    "fmod": ((2,), "float", F.try_mod),
    "relu": ((1,), "float", lambda x: F.greatest(x, F.lit(0.0))),
    "leaky_relu": ((1, 2), "float", lambda x, a=None: F.when(x > 0, x).otherwise((F.lit(0.01) if a is None else a) * x)),
    "sigmoid": ((1,), "float", lambda x: 1 / (1 + F.exp(-x))),
    "gelu": ((1,), "float", lambda x: 0.5 * x * (1 + erf(x / m.sqrt(2)))),
    "silu": ((1,), "float", lambda x: x / (1 + F.exp(-x))),
    "softplus": ((1,), "float", lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))),
    "erf": ((1,), "float", erf),
    "erfc": ((1,), "float", erfc),
    "lgamma": ((1,), "float", lgamma),
    "popcount": ((1,), "int", lambda x: F.bit_count(x.cast("long")).cast("long")),
    "clz": ((1,), "int", lambda x: F.when(x == 0, 64).otherwise(64 - F.length(_bits(x))).cast("long")),
    "ctz": ((1,), "int", lambda x: F.when(x == 0, 64).otherwise(F.length(_bits(x)) - F.length(F.rtrim(_bits(x), F.lit("0")))).cast("long")),
    "rotl": ((2,), "int", _rotl),
    "rotr": ((2,), "int", lambda x, n: _rotl(x, 64 - F.pmod(n.cast("int"), F.lit(64)))),
    "safeDiv": ((2,), "float", lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))),
    "isNan": ((1,), "bool", F.isnan),
    "isInf": ((1,), "bool", lambda x: F.abs(x) == INF),
    "isFinite": ((1,), "bool", lambda x: ~F.isnan(x) & (F.abs(x) < INF)),
    "max": ((2, 3, 4, 5, 6, 7, 8), "same", F.greatest),
    "min": ((2, 3, 4, 5, 6, 7, 8), "same", F.least),
    # strings
    "startsWith": ((2,), "bool", lambda s, p: s.startswith(p)),
    "endsWith": ((2,), "bool", lambda s, p: s.endswith(p)),
    "contains": ((2,), "bool", lambda s, p: s.contains(p)),
    "concat": ((1, 2, 3, 4, 5, 6, 7, 8), "string", F.concat),
    "size": ((1,), "int", lambda x: F.length(x).cast("long")),
}
ALIASES = {"safe_div": "safeDiv", "isnan": "isNan", "isinf": "isInf", "isfinite": "isFinite"}
DOUBLES = {"sqrt", "rsqrt", "relu", "clamp", "lerp", "fmod", "isNan", "isInf", "isFinite", "trunc", "round", "copysign", "leaky_relu", "silu", "softplus", "sigmoid", "gelu", "safeDiv", "sinc"}


def call(name: str, args: Sequence[tuple[Column, str]], error: type[Exception]) -> tuple[Column, str]:
    """(column, kind) of the function ``name`` over typed columns; raises ``error`` for an unknown name or a wrong number of arguments."""
    own = ALIASES.get(name, name)
    if own not in TABLE:
        raise error(f"no function {name}")
    arities, kind, f = TABLE[own]
    if len(args) not in arities:
        raise error(f"{name} takes {' or '.join(map(str, arities))} arguments, not {len(args)}")
    if own == "size" and args[0][1] == "list":
        return F.size(args[0][0]).cast("long"), "int"
    columns = [c.cast("double") if own in DOUBLES and k == "int" else c for c, k in args]
    return f(*columns), args[0][1] if kind == "same" else kind

"""The dialect's functions where Spark's own differ, and the registry of all of them.

Each entry takes columns with their types and gives a column with its type; whatever is not listed is no function of
the dialect."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT, LONG, FLOAT, DOUBLE, STRING, BOOL = T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.StringType(), T.BooleanType()
Typed = tuple[Column, T.DataType]
_RANK = {T.ByteType: 0, T.ShortType: 0, T.IntegerType: 0, T.LongType: 1, T.FloatType: 2, T.DoubleType: 3, T.DecimalType: 4}
INF = math.inf


def is_number(t: T.DataType) -> bool:
    return type(t) in _RANK


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The wider of two numeric types: int, long, float, double, decimal."""
    t = a if _RANK[type(a)] >= _RANK[type(b)] else b
    return INT if _RANK[type(t)] == 0 else t


def widest(types: list[T.DataType]) -> T.DataType:
    """The widest numeric type, or the first that is not null."""
    known = [t for t in types if not isinstance(t, T.NullType)]
    if known and all(map(is_number, known)):
        out = known[0]
        for t in known[1:]:
            out = wider(out, t)
        return wider(out, INT)
    return known[0] if known else T.NullType()


def divide(a: Column, b: Column, t: T.DataType) -> Column:
    """Whole numbers divide to whole numbers, by zero to NULL; floating ones follow IEEE 754."""
    if isinstance(t, T.IntegerType | T.LongType):
        return F.call_function("div", a.cast("bigint"), b.cast("bigint")).cast(t)
    sign = F.when(F.isnan(a) | (a == 0), F.lit(math.nan)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, sign).otherwise(a / b).cast(t)


def modulo(a: Column, b: Column, t: T.DataType) -> Column:
    """The remainder with the dividend's sign; by zero NULL for whole numbers, NaN for floating ones."""
    if isinstance(t, T.IntegerType | T.LongType):
        return (a.cast(t) % b.cast(t)).cast(t)
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, F.lit(math.nan)).otherwise(a % b).cast(t)


def correlation(x: Column, y: Column) -> Column:
    """CORR of two doubles; NULL where a side is the same in all pairs. Spark's variance does not tell: merging partial
    means leaves a constant with a variance of rounding errors in some layouts, and the quotient is noise then."""
    out = F.corr(x, y)
    same = [F.min(c) == F.max(c) for c in (F.when(y.isNotNull(), x), F.when(x.isNotNull(), y))]
    return F.when((same[0] | same[1]) & ~F.isnan(out), None).otherwise(out)


def _whole(c: Column, f: Callable[[Column], Column]) -> Column:
    """floor or ceil as double; doubles beyond 2**53 are whole already."""
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**53), x).otherwise(f(x).cast("double"))


def _scaled(args: list[Typed]) -> tuple[Column, Column]:
    return args[0][0].cast("double"), F.pow(F.lit(10.0), args[1][0].cast("double")) if len(args) > 1 else F.lit(1.0)


def _round(args: list[Typed]) -> Column:
    x, p = _scaled(args)
    y = x * p
    return F.when(F.isnan(y), F.lit(0.0)).when(F.abs(y) >= 2.0**53, x).otherwise(F.floor(y + 0.5).cast("double") / p)


def _trunc(args: list[Typed]) -> Column:
    x, p = _scaled(args)
    y = x * p
    return F.when(F.isnan(y) | (F.abs(y) >= 2.0**53), x).otherwise(F.signum(x) * F.floor(F.abs(y)) / p + F.lit(0.0))


def _log(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """IEEE logarithms: minus infinity at zero, NaN below."""
    return lambda x: F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(math.nan)).otherwise(f(x))


_ln = _log(F.ln)


def _substring(args: list[Typed]) -> Column:
    s = args[0][0].cast("string")
    start = F.greatest(args[1][0].cast("int"), F.lit(1))
    return F.substring(s, start, args[2][0].cast("int") if len(args) > 2 else F.length(s))


def seeded_random(seed: int) -> float:
    """The first double of the 48-bit linear congruential generator that Java's random numbers come from."""
    mask = (1 << 48) - 1
    state = (seed ^ 0x5DEECE66D) & mask
    bits = []
    for width in (26, 27):
        state = (state * 0x5DEECE66D + 0xB) & mask
        bits.append(state >> (48 - width))
    return ((bits[0] << 27) + bits[1]) / (1 << 53)


def _same(f: Callable[..., Column], n: int = 1, t: T.DataType = DOUBLE, cast: str = "double"):
    return (n, n), lambda a: f(*[c.cast(cast) for c, _ in a]), lambda _: t


def _pick(f: Callable[..., Column]):
    """One of the arguments, all cast to their widest type."""
    return (1, 255), lambda a: f(*[c.cast(widest([t for _, t in a])) for c, _ in a]) if len(a) > 1 else a[0][0], lambda ts: widest(ts)


def _if(a: list[Typed]) -> Column:
    t = widest([a[1][1], a[2][1]])
    return F.when(a[0][0], a[1][0].cast(t)).otherwise(a[2][0].cast(t))


_LOW = "".join(map(chr, range(33)))
#: Name: least and greatest number of arguments, the column, the type.
FUNCTIONS: dict[str, tuple[tuple[int, int], Callable[[list[Typed]], Column], Callable[[list[T.DataType]], T.DataType]]] = {
    "length": ((1, 1), lambda a: F.length(a[0][0].cast("string")), lambda _: INT),
    "upper": _same(F.upper, t=STRING, cast="string"),
    "lower": _same(F.lower, t=STRING, cast="string"),
    "trim": ((1, 1), lambda a: F.btrim(a[0][0].cast("string"), F.lit(_LOW)), lambda _: STRING),
    "substring": ((2, 3), _substring, lambda _: STRING),
    "concat": ((1, 255), lambda a: F.concat(*[c.cast("string") for c, _ in a]), lambda _: STRING),
    "coalesce": _pick(F.coalesce),
    "greatest": _pick(F.greatest),
    "least": _pick(F.least),
    "if": ((3, 3), _if, lambda t: widest(t[1:])),
    "nullif": ((2, 2), lambda a: F.nullif(a[0][0], a[1][0]), lambda t: t[0]),
    "abs": ((1, 1), lambda a: F.abs(a[0][0]), lambda t: t[0]),
    "round": ((1, 2), _round, lambda _: DOUBLE),
    "floor": ((1, 1), lambda a: _whole(a[0][0], F.floor), lambda _: DOUBLE),
    "ceil": ((1, 1), lambda a: _whole(a[0][0], F.ceil), lambda _: DOUBLE),
    "trunc": ((1, 2), _trunc, lambda _: DOUBLE),
    "mod": ((2, 2), lambda a: modulo(a[0][0], a[1][0], wider(a[0][1], a[1][1])), lambda t: wider(t[0], t[1])),
    "pow": _same(F.pow, 2),
    "sqrt": _same(F.sqrt),
    "cbrt": _same(F.cbrt),
    "exp": _same(F.exp),
    "ln": _same(_ln),
    "log": ((1, 2), lambda a: _ln(a[0][0].cast("double")) if len(a) == 1 else divide(_ln(a[1][0].cast("double")), _ln(a[0][0].cast("double")), DOUBLE), lambda _: DOUBLE),
    "log10": _same(_log(F.log10)),
    "log2": _same(_log(F.log2)),
    **{n: _same(getattr(F, n)) for n in "sin cos tan asin acos atan sinh cosh tanh degrees radians".split()},
    "atan2": _same(F.atan2, 2),
    "sign": ((1, 1), lambda a: F.signum(a[0][0].cast("double")).cast("int"), lambda _: INT),
    "pi": ((0, 0), lambda _: F.lit(math.pi), lambda _: DOUBLE),
    "e": ((0, 0), lambda _: F.lit(math.e), lambda _: DOUBLE),
    "rand": ((0, 0), lambda _: F.rand(), lambda _: DOUBLE),
    "current_date": ((0, 0), lambda _: F.current_date(), lambda _: T.DateType()),
    "current_timestamp": ((0, 0), lambda _: F.current_timestamp(), lambda _: T.TimestampType()),
}
#: Other names of functions.
for _new, _old in {"len": "length", "ceiling": "ceil", "truncate": "trunc", "power": "pow", "random": "rand"}.items():
    FUNCTIONS[_new] = FUNCTIONS[_old]

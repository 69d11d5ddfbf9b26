"""Strict SQL trees to DataFrames: names and types are bound against the tables' schemas and only built-in expressions
are emitted, so Catalyst optimizes the whole query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strict import BOOL, DOUBLE, FUNCTIONS, INT, LONG, STRING, Typed, correlation, divide, is_number, modulo, seeded_random, wider, widest
from .parser import Select, SqlError, Union, parse

#: Rows of the smaller side above which a join without an equality is refused, when the guard is on.
MAX_NONEQUI_ROWS = 5000
_MOMENTS = {
    **dict.fromkeys(("stddev", "stddev_samp", "stdev"), F.stddev_samp), **dict.fromkeys(("stddev_pop", "stdevp"), F.stddev_pop),
    **dict.fromkeys(("variance", "var_samp", "var"), F.var_samp), **dict.fromkeys(("var_pop", "varp"), F.var_pop),
}
_PAIRS = {"covar_samp": F.covar_samp, "covar_pop": F.covar_pop, "corr": F.corr}
AGGREGATES = frozenset(("count", "sum", "avg", "min", "max", "count_if", *_MOMENTS, *_PAIRS))
RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}


@dataclass
class Field:
    table: str | None
    name: str
    inner: str
    type: T.DataType


class Scope:
    """The columns that expressions can name, and expressions already computed (grouping keys, aggregates)."""

    def __init__(self, fields: list[Field], known: dict[tuple, Typed] | None = None, grouped: bool = False):
        self.fields, self.known, self.grouped = fields, known or {}, grouped

    def find(self, table: str | None, name: str) -> Field | None:
        got = [f for f in self.fields if f.name.lower() == name and table in (None, f.table)]
        if len(got) > 1:
            raise SqlError(f"Ambiguous column reference '{name}': it is in {', '.join(str(f.table) for f in got)}")
        return got[0] if got else None


def _walk(tree, seen) -> None:
    """Call seen(node) on each node from the top; where it answers true, do not go below."""
    if isinstance(tree, tuple):
        if tree and isinstance(tree[0], str) and seen(tree):
            return
        for x in tree:
            _walk(x, seen)


def aggregates(tree) -> list[tuple]:
    """Aggregate calls of a tree, those under windows' arguments included, windows themselves not."""
    out: list[tuple] = []

    def seen(n: tuple) -> bool:
        if n[0] == "over":
            for part in (n[1][2], n[2], n[3]):
                out.extend(aggregates(part))
            return True
        if n[0] == "fn" and n[1] in AGGREGATES:
            out.append(n)
            return True
        return False

    _walk(tree, seen)
    return out


def _has_window(tree) -> bool:
    found = []
    _walk(tree, lambda n: n[0] == "over" and not found.append(n))
    return bool(found)


class Binder:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], max_nonequi_rows: int | None = None):
        self.spark, self.tables, self.guard, self.n = spark, {k.lower(): v for k, v in tables.items()}, max_nonequi_rows, 0

    def fresh(self) -> str:
        self.n += 1
        return f"_c{self.n}"

    # expressions
    def bind(self, e: tuple, s: Scope) -> Typed:
        if e in s.known:
            return s.known[e]
        return getattr(self, f"_{e[0]}")(e, s)

    def _lit(self, e, s) -> Typed:
        v = e[1]
        if v is None:
            return F.lit(None), T.NullType()
        t = STRING if isinstance(v, str) else DOUBLE if isinstance(v, float) else INT if -(1 << 31) <= v < 1 << 31 else LONG
        return F.lit(v).cast(t), t

    def _col(self, e, s) -> Typed:
        f = s.find(e[1], e[2])
        if f is None:
            if e[1] is None and e[2] in ("true", "false"):
                return F.lit(e[2] == "true"), BOOL
            if e[1] is None and e[2] in ("current_date", "current_timestamp"):
                return self._fn(("fn", e[2], (), False), s)
            names = ", ".join(f"{f.table}.{f.name}" if f.table else f.name for f in s.fields)
            what = f"{e[1]}.{e[2]}" if e[1] else e[2]
            extra = " (it is neither grouped nor aggregated)" if s.grouped else ""
            raise SqlError(f"Unknown column '{what}'{extra}. Available: {names}")
        return F.col(f.inner), f.type

    def _star(self, e, s) -> Typed:
        raise SqlError("* cannot stand here")

    def _un(self, e, s) -> Typed:
        c, t = self.bind(e[2], s)
        return (~self.as_bool(c, t), BOOL) if e[1] == "not" else (-c, t)

    @staticmethod
    def as_bool(c: Column, t: T.DataType) -> Column:
        if is_number(t):
            return c != 0
        if isinstance(t, T.StringType):
            return F.lower(c) == "true"
        return c.cast("boolean")

    def _bin(self, e, s) -> Typed:
        op = e[1]
        (a, ta), (b, tb) = self.bind(e[2], s), self.bind(e[3], s)
        if op in ("and", "or"):
            a, b = self.as_bool(a, ta), self.as_bool(b, tb)
            return (a & b if op == "and" else a | b), BOOL
        if op == "||":
            return F.concat(a.cast("string"), b.cast("string")), STRING
        if op in ("=", "<>", "<", "<=", ">", ">="):
            a, b = self.comparable(a, ta, b, tb)
            return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op], BOOL
        null = isinstance(ta, T.NullType) or isinstance(tb, T.NullType)
        ta, tb = (tb if isinstance(ta, T.NullType) else ta), (ta if isinstance(tb, T.NullType) else tb)
        if null and isinstance(ta, T.NullType):
            return F.lit(None), ta
        if not (is_number(ta) and is_number(tb)):
            raise SqlError(f"Operator {op} needs numbers, not {ta.simpleString()} and {tb.simpleString()}")
        t = wider(ta, tb)
        a, b = a.cast(t), b.cast(t)
        if op == "/":
            return divide(a, b, t), t
        if op == "%":
            return modulo(a, b, t), t
        return {"+": a + b, "-": a - b, "*": a * b}[op].cast(t), t

    @staticmethod
    def comparable(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> tuple[Column, Column]:
        """Both sides as they are compared: a string against anything else is compared as text."""
        if isinstance(ta, T.NullType) or isinstance(tb, T.NullType) or isinstance(ta, T.StringType) == isinstance(tb, T.StringType):
            return a, b
        return a.cast("string"), b.cast("string")

    def _isnull(self, e, s) -> Typed:
        c = self.bind(e[1], s)[0]
        return (c.isNotNull() if e[2] else c.isNull()), BOOL

    def _in(self, e, s) -> Typed:
        c, t = self.bind(e[1], s)
        out = c.isin(*[self.comparable(*self.bind(x, s), c, t)[0] if isinstance(t, T.StringType) else self.bind(x, s)[0] for x in e[2]])
        return (~out if e[3] else out), BOOL

    def _between(self, e, s) -> Typed:
        c, _ = self.bind(("bin", "and", ("bin", ">=", e[1], e[2]), ("bin", "<=", e[1], e[3])), s)
        return (~c if e[4] else c), BOOL

    def _like(self, e, s) -> Typed:
        if e[2][0] != "lit" or not isinstance(e[2][1], str):
            raise SqlError("LIKE needs a string literal")
        c = self.bind(e[1], s)[0].cast("string").like(e[2][1])
        return (~c if e[3] else c), BOOL

    def _case(self, e, s) -> Typed:
        values = [(self.as_bool(*self.bind(w, s)), *self.bind(v, s)) for w, v in e[1]]
        other, t_other = self.bind(e[2], s)
        t = widest([*(v[2] for v in values), t_other])
        out = None
        for test, c, _ in values:
            out = F.when(test, c.cast(t)) if out is None else out.when(test, c.cast(t))
        return out.otherwise(other.cast(t)), t

    def _cast(self, e, s) -> Typed:
        c, t = self.bind(e[1], s)
        to = {"int": INT, "bigint": LONG, "float": T.FloatType(), "double": DOUBLE, "string": STRING, "boolean": BOOL, "date": T.DateType(), "timestamp": T.TimestampType()}[e[2]]
        if isinstance(t, T.StringType) and isinstance(to, T.BooleanType):
            return F.lower(c) == "true", to
        out = c.cast(to)
        if isinstance(t, T.StringType) and not isinstance(to, T.StringType):
            bad = F.raise_error(F.concat(F.lit(f"Cannot cast to {e[2]}: "), c))
            out = F.when(c.isNotNull() & out.isNull(), bad.cast(to)).otherwise(out)
        return out, to

    def _fn(self, e, s) -> Typed:
        _, name, args, _ = e
        if name in AGGREGATES:
            raise SqlError(f"Aggregate {name.upper()} cannot be used here")
        if name in RANKS or name in ("lag", "lead"):
            raise SqlError(f"{name.upper()} needs OVER")
        if name in ("rand", "random") and len(args) == 1 and args[0][0] == "lit":
            return F.lit(seeded_random(args[0][1])), DOUBLE
        bound = [self.bind(a, s) for a in args]
        got = FUNCTIONS.get(name)
        if got is None or not got[0][0] <= len(bound) <= got[0][1]:
            raise SqlError(f"Unknown function {name}({', '.join(t.simpleString() for _, t in bound)})")
        t = got[2]([t for _, t in bound])
        return got[1](bound).cast(t), t

    def aggregate(self, e: tuple, s: Scope) -> Typed:
        """An aggregate call over the rows of a group or a window."""
        _, name, args, distinct = e
        if name == "count" and args == (("star", None),):
            return F.count("*"), LONG
        bound = [self.bind(a, s) for a in args]
        if len(bound) != (2 if name in _PAIRS else 1):
            raise SqlError(f"{name.upper()} takes {2 if name in _PAIRS else 1} argument(s)")
        c, t = bound[0]
        if name == "count":
            return (F.count_distinct(c) if distinct else F.count(c)), LONG
        if name == "count_if":
            return F.count_if(self.as_bool(c, t)), LONG
        if name in ("min", "max"):
            return (F.min(c) if name == "min" else F.max(c)), t
        if name == "sum":
            whole = isinstance(t, T.IntegerType | T.LongType)
            return (F.sum_distinct(c) if distinct else F.sum(c)).cast(LONG if whole else DOUBLE), LONG if whole else DOUBLE
        if name == "avg":
            return (F.sum_distinct(c) / F.count_distinct(c) if distinct else F.avg(c)).cast(DOUBLE), DOUBLE
        if name == "corr":
            return correlation(c.cast(DOUBLE), bound[1][0].cast(DOUBLE)), DOUBLE
        if name in _PAIRS:
            return _PAIRS[name](c.cast(DOUBLE), bound[1][0].cast(DOUBLE)), DOUBLE
        return _MOMENTS[name](c.cast(DOUBLE)), DOUBLE

    def _over(self, e, s) -> Typed:
        _, fn, parts, order, frame = e
        name, args = fn[1], fn[2]
        w = Window.partitionBy(*[self.bind(p, s)[0] for p in parts]) if parts else Window.partitionBy(F.lit(0))
        if order:
            w = w.orderBy(*[self.key(self.bind(k, s)[0], asc) for k, asc in order])
        if name in RANKS:
            return RANKS[name]().over(w if order else w.orderBy(F.lit(0))).cast(LONG), LONG
        if name in ("lag", "lead"):
            c, t = self.bind(args[0], s)
            n = args[1][1] if len(args) > 1 else 1
            if not isinstance(n, int) or n < 0:
                raise SqlError(f"{name.upper()}'s offset must be a non-negative integer literal")
            w = w if order else w.orderBy(F.lit(0))
            shift = F.lag if name == "lag" else F.lead
            if len(args) < 3:
                return shift(c, n).over(w), t
            d, _ = self.bind(args[2], s)
            there = shift(F.lit(1), n).over(w)
            return F.when(there.isNull(), d.cast(t)).otherwise(shift(c, n).over(w)), t
        if name not in AGGREGATES or name in _PAIRS:
            raise SqlError(f"{name.upper()} is no window function")
        low, high = frame if frame else (None, 0) if order else (None, None)
        w = w.rowsBetween(Window.unboundedPreceding if low is None else low, Window.unboundedFollowing if high is None else high)
        if name == "count" and fn[3]:
            return F.size(F.collect_set(self.bind(args[0], s)[0]).over(w)).cast(LONG), LONG
        c, t = self.aggregate((*fn[:3], False), s)
        if name == "sum" or isinstance(t, T.DoubleType) and name not in ("min", "max"):
            return self._plain(fn, s, w).cast(t), t
        return c.over(w), t

    def _plain(self, fn: tuple, s: Scope, w) -> Column:
        """Aggregates whose result is cast: the window goes inside the cast."""
        c, _ = self.bind(fn[2][0], s)
        return {"sum": F.sum, "avg": F.avg, **_MOMENTS}[fn[1]](c).over(w)

    def distinct_counts(self, df: DataFrame, s: Scope, trees: tuple) -> DataFrame:
        """`df` with a column for each COUNT(DISTINCT x) OVER of the trees whose frame is the whole partition or runs from
        its start to the current row; the scope knows them. Neither builds sets: the first is the highest dense rank, the
        second a running sum over first occurrences."""
        calls: list[tuple] = []
        _walk(trees, lambda n: n[0] == "over" and n[1][1] == "count" and n[1][3] and not calls.append(n))
        for e in dict.fromkeys(calls):
            _, fn, parts, order, frame = e
            low, high = frame if frame else (None, 0) if order else (None, None)
            if low is not None or high not in (None, 0) or not parts or (high == 0 and not order):
                continue
            x, rank, rows, out = (self.fresh() for _ in range(4))
            df = df.withColumn(x, self.bind(fn[2][0], s)[0])
            keys = [self.bind(p, s)[0] for p in parts]
            if high is None:
                df = df.withColumn(rank, F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last())))
                count = F.max(F.when(F.col(x).isNotNull(), F.col(rank))).over(Window.partitionBy(*keys))
            else:
                df = df.withColumn(rows, F.monotonically_increasing_id())  # one order for both windows, ties included
                by = [*(self.key(self.bind(k, s)[0], asc) for k, asc in order), F.col(rows).asc()]
                df = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys, x).orderBy(*by)))
                first = F.when(F.col(x).isNotNull() & (F.col(rank) == 1), 1).otherwise(0)
                count = F.sum(first).over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
            df = df.withColumn(out, F.coalesce(count, F.lit(0)).cast(LONG))
            s.known[e] = (F.col(out), LONG)
        return df

    @staticmethod
    def key(c: Column, asc: bool) -> Column:
        return c.asc_nulls_first() if asc else c.desc_nulls_last()

    # queries
    def query(self, q: Select | Union) -> tuple[DataFrame, list[Field]]:
        return self.union(q) if isinstance(q, Union) else self.select(q)

    def union(self, q: Union) -> tuple[DataFrame, list[Field]]:
        (a, fa), (b, fb) = self.query(q.left), self.query(q.right)
        if len(fa) != len(fb):
            raise SqlError(f"UNION arms have {len(fa)} and {len(fb)} columns")
        df = a.union(b)
        if not q.all:
            df = df.distinct()
        fields = [Field(None, f.name, c, t.dataType) for f, c, t in zip(fa, df.columns, df.schema.fields, strict=True)]
        return self.finish(df, q, fields, Scope(fields))

    def finish(self, df: DataFrame, q: Select | Union, fields: list[Field], s: Scope) -> tuple[DataFrame, list[Field]]:
        if q.order:
            df = df.orderBy(*[self.key(self.order_key(k, s, fields), asc) for k, asc in q.order])
        return (df if q.limit is None else df.limit(q.limit)), fields

    def order_key(self, k: tuple, s: Scope, out: list[Field]) -> Column:
        if k[0] == "lit" and isinstance(k[1], int) and 1 <= k[1] <= len(out):
            return F.col(out[k[1] - 1].inner)
        try:
            return self.bind(k, s)[0]
        except SqlError:
            named = [f for f in out if k[0] == "col" and k[1] is None and f.name.lower() == k[2]]
            if len(named) != 1:
                raise
            return F.col(named[0].inner)

    def source(self, name: str, alias: str) -> tuple[DataFrame, list[Field]]:
        if name not in self.tables:
            raise SqlError(f"Unknown view '{name}'. Known views: {', '.join(sorted(self.tables))}")
        df = self.tables[name]
        fields = [Field(alias, f.name, self.fresh(), f.dataType) for f in df.schema.fields]
        return df.toDF(*[f.inner for f in fields]), fields

    def sources(self, q: Select) -> tuple[DataFrame, list[Field]]:
        df, fields = self.source(*q.tables[0][1:3])
        for kind, name, alias, on in q.tables[1:]:
            right, more = self.source(name, alias)
            both = [*fields, *more]
            if on is None:
                df = df.crossJoin(right)
            else:
                if self.guard is not None and not self.equates(on, fields, more):
                    a, b = df.limit(self.guard + 1).count(), right.limit(self.guard + 1).count()
                    if min(a, b) > self.guard:
                        raise SqlError(f"A join without an equality needs a side of at most {self.guard} rows; both sides have more")
                df = df.join(right, self.as_bool(*self.bind(on, Scope(both))), {"cross": "inner"}.get(kind, kind))
            fields = both
        return df, fields

    @staticmethod
    def equates(on: tuple, left: list[Field], right: list[Field]) -> bool:
        def side(e: tuple) -> set:
            cols: list[tuple] = []
            _walk(e, lambda n: n[0] == "col" and not cols.append(n))
            return {k for k, fs in (("l", left), ("r", right)) for c in cols if any(f.name.lower() == c[2] and c[1] in (None, f.table) for f in fs)}

        if on[0] == "bin" and on[1] == "and":
            return Binder.equates(on[2], left, right) or Binder.equates(on[3], left, right)
        return on[0] == "bin" and on[1] == "=" and {frozenset(side(on[2])), frozenset(side(on[3]))} == {frozenset("l"), frozenset("r")}

    def select(self, q: Select) -> tuple[DataFrame, list[Field]]:
        df, fields = self.sources(q)
        s = Scope(fields)
        if q.where is not None:
            if aggregates(q.where) or _has_window(q.where):
                raise SqlError("WHERE cannot hold aggregates or window functions")
            df = df.where(self.as_bool(*self.bind(q.where, s)))
        items = []
        for e, name, text in q.items:
            if e[0] == "star":
                mine = [f for f in fields if e[1] in (None, f.table)]
                if not mine:
                    raise SqlError(f"Unknown table '{e[1]}'")
                items += [(("col", f.table, f.name.lower()), f.name, f.name) for f in mine]
            else:
                items.append((e, name, text))
        trees = [e for e, _, _ in items]
        calls = list(dict.fromkeys(aggregates((*trees, q.having, tuple(q.order)))))
        if q.group or calls:
            df, s = self.group(df, s, q, trees, calls)
        elif q.having is not None:
            raise SqlError("HAVING needs GROUP BY or an aggregate")
        df = self.distinct_counts(df, s, (*trees, tuple(q.order)))
        bound = [self.bind(e, s) for e in trees]
        out = [Field(None, name or (text.split(".")[-1] if e[0] == "col" else text.lower()), self.fresh(), t) for (e, name, text), (_, t) in zip(items, bound, strict=True)]
        df = df.withColumns({f.inner: c for f, (c, _) in zip(out, bound, strict=True)})
        if q.distinct:
            df = df.select(*[f.inner for f in out]).distinct()
            known = {e: (F.col(f.inner), f.type) for e, f in zip(trees, out, strict=True)}
            s = Scope(out, known)
        df, _ = self.finish(df, q, out, s)
        return df.select(*[f.inner for f in out]), out

    def group(self, df: DataFrame, s: Scope, q: Select, trees: list[tuple], calls: list[tuple]) -> tuple[DataFrame, Scope]:
        keys = []
        for g in q.group:
            if g[0] == "lit" and isinstance(g[1], int):
                if not 1 <= g[1] <= len(trees):
                    raise SqlError(f"GROUP BY position {g[1]} is not in the select list (1 to {len(trees)})")
                g = trees[g[1] - 1]
            if aggregates(g):
                raise SqlError("GROUP BY cannot hold aggregates")
            keys.append(g)
        known: dict[tuple, Typed] = {}
        group_cols, fields = [], []
        for g in dict.fromkeys(keys):
            c, t = self.bind(g, s)
            inner = self.fresh()
            group_cols.append(c.alias(inner))
            known[g] = (F.col(inner), t)
            if g[0] == "col":
                f = s.find(g[1], g[2])
                fields.append(Field(f.table, f.name, inner, t))
        agg_cols = []
        for call in calls:
            c, t = self.aggregate(call, s)
            inner = self.fresh()
            agg_cols.append(c.alias(inner))
            known[call] = (F.col(inner), t)
        grouped = df.groupBy(*group_cols)
        df = grouped.agg(*agg_cols) if agg_cols else df.select(*group_cols).distinct()
        after = Scope(fields, known, grouped=True)
        if q.having is not None:
            df = df.where(self.as_bool(*self.bind(q.having, after)))
        return df, after


def bind_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame], max_nonequi_rows: int | None = None) -> DataFrame:
    """A strict query over tables. Output names may repeat."""
    df, out = Binder(spark, tables, max_nonequi_rows).query(parse(sql))
    return df.toDF(*[f.name for f in out])

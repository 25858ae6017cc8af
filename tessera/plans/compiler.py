"""From trees to Spark: clauses become DataFrames, phrases become expressions.

An environment binds names to tables, expressions and functions.  A phrase is a
column expression over nothing (``Typed``): its type is known when it is compiled,
so verbs pick their rule then, and Catalyst folds what is constant.  Loops and
conditions on single values run on the driver; ``if`` inside a clause is ``case``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import CallError, KindError, ParseError, wrapped
from tessera.functions import atomic, cells
from tessera.functions.atomic import Typed
from tessera.functions.order import grade, match, sort_key
from tessera.operators import dml
from tessera.operators.vectors import ordinals, running
from tessera.plans.parser import parse
from tessera.sources import drive

#: Aggregates by name.
AGGREGATES: dict[str, Callable[..., Column]] = {
    "sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "first": F.first, "last": F.last,
    "stddev": F.stddev, "variance": F.variance, "median": F.median, "mode": F.mode, "product": F.product, "countdistinct": F.count_distinct,
    "approxdistinct": F.approx_count_distinct, "collect": F.collect_list, "percentile": F.percentile_approx, "any": F.bool_or, "every": F.bool_and,
}
#: Functions that stand before over only.
RANKS: dict[str, Callable[..., Column]] = {
    "row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist,
    "ntile": F.ntile, "lag": F.lag, "lead": F.lead, "nth": F.nth_value,
}
#: Functions of values by name.
SCALARS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "sin": F.sin, "cos": F.cos, "tan": F.tan, "floor": F.floor, "ceil": F.ceil,
    "least": F.least, "greatest": F.greatest, "upper": F.upper, "lower": F.lower, "trim": F.trim, "length": F.length, "substring": lambda c, i, n: F.substring(c, i, n),
    "replace": F.replace, "split": F.split, "concat": F.concat, "coalesce": F.coalesce, "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
    "quarter": F.quarter, "week": F.weekofyear, "weekday": F.dayofweek, "datediff": F.datediff, "addmonths": F.add_months, "date": lambda c: c.cast("date"), "datetime": lambda c: c.cast("timestamp_ntz"),
    "pow": F.pow, "mod": F.pmod, "sign": F.signum, "cbrt": F.cbrt, "log2": F.log2, "log10": F.log10, "bool": lambda c: c.cast("boolean"), "nullif": F.nullif, "startswith": F.startswith, "endswith": F.endswith, "repeat": F.repeat, "lpad": F.lpad, "rpad": F.rpad,
    "hash": F.xxhash64, "int": lambda c: c.cast("long"), "float": lambda c: c.cast("double"), "string": lambda c: c.cast("string"),
    "reverse": F.reverse, "distinct": F.array_distinct, "size": F.size, "keys": F.map_keys, "values": F.map_values, "enlist": F.array, "flatten": F.flatten, "isnull": F.isnull,
}
#: Functions with an argument that must be a literal: its place, and the function.
LITERALS: dict[str, tuple[int, Callable[..., Column]]] = {
    "round": (1, F.round),
    "truncate": (0, F.date_trunc),
    "format": (1, F.date_format),
    "parse": (1, lambda c, form: F.to_timestamp_ntz(c, F.lit(form))),
    "jsonpath": (1, F.get_json_object),
    "tojson": (1, F.from_json),
}


@dataclass
class Function:
    names: list[str]
    body: tuple
    env: Environment


class _Return(Exception):
    def __init__(self, value) -> None:
        self.value = value


@dataclass
class Environment:
    """Names and what they stand for; a name that isn't bound is looked up in the
    environment around it, then in the catalogue."""

    spark: SparkSession
    names: dict = field(default_factory=dict)
    outer: Environment | None = None

    def get(self, name: str):
        env: Environment | None = self
        while env is not None:
            if name in env.names:
                return env.names[name]
            env = env.outer
        return None

    def table(self, name: str) -> DataFrame:
        got = self.get(name)
        if isinstance(got, DataFrame):
            return got
        if got is None and self.spark.catalog.tableExists(name):
            return self.spark.table(name)
        raise KindError(f"{name} is no table")

    def set(self, name: str, value) -> None:
        self.names[name] = value

    # ------------------------------------------------------------------ running

    def run(self, text: str):
        """The value of the last statement of a program."""
        with wrapped():
            return self._block(parse(text))

    def show(self, text: str):
        """As ``run``, but expressions come back as Python values."""
        got = self.run(text)
        return self._python(got) if isinstance(got, Typed) else got

    def timed(self, text: str) -> tuple:
        """(the value of ``show``, seconds); tables are run."""
        began = time.perf_counter()
        got = self.show(text)
        if isinstance(got, DataFrame):
            got.write.format("noop").mode("overwrite").save()
        return got, time.perf_counter() - began

    def _python(self, value: Typed):
        with wrapped():
            return self.spark.range(1).select(value.column.alias("v")).first()[0]

    def _block(self, tree: tuple):
        out = None
        for s in tree[1]:
            out = self._statement(s)
        return out

    def _statement(self, s: tuple):
        kind = s[0]
        if kind == "assign":
            return self._assign(*s[1:])
        if kind == "def":
            self.set(s[1], Function(s[2], s[3], self))
            return None
        if kind == "return":
            raise _Return(self._statement(s[1]))
        if kind == "if":
            branch = s[2] if self._holds(s[1]) else s[3]
            return self._block(branch) if branch else None
        if kind == "while":
            out = None
            while self._holds(s[1]):
                out = self._block(s[2])
            return out
        if kind == "do":
            out = None
            for _ in range(int(self._python(self.expression(s[1])))):
                out = self._block(s[2])
            return out
        if kind == "for":
            self._statement(s[1])
            out = None
            while self._holds(s[2]):
                out = self._block(s[4])
                self._statement(s[3])
            return out
        if kind in ("select", "insert", "update", "upsert", "delete"):
            return getattr(self, f"_{kind}")(*s[1:])
        if kind == "drive":
            return self._drive(*s[1:])
        if kind == "name" and isinstance(self.get(s[1]), (DataFrame, Function)):
            return self.get(s[1])
        return self.expression(s)

    def _drive(self, verb: str, name: str, where: tuple):
        """``name << path`` reads what is stored there and ``<<=`` maps it: tables are read when
        they are used in both, and values of other kinds at once.  ``>>`` writes a table as one
        Parquet table and ``>>=`` any value as a directory."""
        path = self._python(self.expression(where))
        if not isinstance(path, str):
            raise KindError("a path is a string")
        if verb in ("<<", "<<="):
            got = drive.read(path, self.spark)
            self.set(name, got if isinstance(got, (DataFrame, dict, list)) else self.typed(F.lit(got)))
            return self.get(name)
        value = self.get(name)
        if value is None:
            value = self.table(name)
        if isinstance(value, Typed):
            value = self._python(value)
        drive.write(value, path, self.spark, "file" if verb == ">>" and isinstance(value, DataFrame) else "directory")
        return None

    def _holds(self, test: tuple) -> bool:
        v = self._python(self.expression(test))
        return bool(v) if isinstance(v, (int, float, bool)) else v is not None

    def _fixed(self, value: Typed) -> Typed:
        """A single value computed now, so that loops don't grow expressions."""
        if isinstance(value.kind, (*atomic.NUMBERS, T.BooleanType, T.StringType)):
            return Typed(F.lit(self._python(value)).cast(value.kind), value.kind)
        return value

    def _assign(self, name: str, index: list | None, verb: str | None, what: tuple):
        value = self._statement(what)
        if index is not None:
            old = self.get(name)
            if not isinstance(old, Typed):
                raise KindError(f"{name} is no vector")
            at = self.expression(index[0])
            if isinstance(old.kind, T.MapType):
                now = cells.lookup(old.column, at.column)
                new = value.column if verb is None else self._dyad(verb, Typed(now, old.kind.valueType), value).column
                column = cells.upsert(old.column, at.column, new.cast(old.kind.valueType))
            else:
                now = Typed(cells.item(old.column, at.column), old.kind.elementType)
                new = value.column if verb is None else self._dyad(verb, now, value).column
                column = cells.amend(old.column, at.column, new.cast(old.kind.elementType))
            value = Typed(column, old.kind)
        elif verb is not None:
            old = self.get(name)
            if isinstance(old, DataFrame):
                raise KindError(f"{verb} is no verb of tables")
            value = self._dyad(verb, old, value)
        self.set(name, self._fixed(value) if isinstance(value, Typed) else value)
        return self.get(name)

    # -------------------------------------------------------------- expressions

    def typed(self, column: Column, over: DataFrame | None = None) -> Typed:
        return Typed.of(over if over is not None else self.spark.range(1), column)

    def made(self, f: Callable[..., Column], *args: Typed, over: DataFrame | None = None) -> Typed:
        """f of some expressions; under a lambda, typed by what f makes of nulls."""
        if any(a.bound for a in args):
            return Typed(f(*args), self.typed(f(*[a.blank() for a in args])).kind, True)
        return self.typed(f(*args), over)

    def expression(self, e: tuple, over: DataFrame | None = None) -> Typed:
        """The expression of a tree; names are columns of ``over`` first."""
        kind = e[0]
        if kind in ("number", "string", "symbol", "constant"):
            return self.typed(F.lit(e[1]).cast("long") if isinstance(e[1], int) and not isinstance(e[1], bool) else F.lit(e[1]))
        if kind == "datetime":
            d, _, t = e[1].replace("-", ".").partition("T")
            y, m, day = d.split(".")
            return self.typed(F.lit(f"{int(y):04d}-{int(m):02d}-{int(day):02d}T{t if t.count(':') == 2 else t + ':00'}").cast("timestamp_ntz"))
        if kind == "date":
            y, m, day = e[1].split(".")
            return self.typed(F.lit(f"{int(y):04d}-{int(m):02d}-{int(day):02d}").cast("date"))
        if kind == "time":  # microseconds since midnight
            h, m, *s = e[1].split(":")
            return self.typed(F.lit(int((int(h) * 3600 + int(m) * 60) * 1_000_000 + (round(float(s[0]) * 1_000_000) if s else 0))).cast("long"))
        if kind == "span":
            return self._span(e[1])
        if kind == "list":
            return self._list(e[1], over)
        if kind == "name":
            return self._name(e[1], over)
        if kind == "monad":
            return self._monad(e[1], self.expression(e[2], over), over)
        if kind == "dyad":
            return self._dyad(e[1], self.expression(e[2], over), self.expression(e[3], over), over)
        if kind == "adverb":
            return self._adverb(*e[1:], over=over)
        if kind == "index":
            return self._index(self.expression(e[1], over), [self.expression(i, over) for i in e[2]], over)
        if kind == "call":
            return self._call(e[1], e[2], over)
        if kind in ("and", "or"):
            a, b = (self.expression(x, over) for x in e[1:])
            return self.made(lambda x, y: x.column & y.column if kind == "and" else x.column | y.column, a, b, over=over)
        if kind == "not":
            return self.made(lambda x: ~x.column, self.expression(e[1], over), over=over)
        if kind == "isnull":
            return self.typed(self.expression(e[1], over).column.isNull(), over)
        if kind == "in":
            if e[2][0] != "list":
                raise ParseError("a table after in stands on its own in where")
            return self.typed(self.expression(e[1], over).column.isin(*[self.expression(x, over).column for x in e[2][1]]), over)
        if kind == "between":
            return self.typed(self.expression(e[1], over).column.between(self.expression(e[2], over).column, self.expression(e[3], over).column), over)
        if kind in ("like", "rlike"):
            return self.typed(getattr(self.expression(e[1], over).column, kind)(e[2][1]), over)
        if kind == "case":
            out = None
            for test, value in e[1]:
                t, v = self.expression(test, over).column, self.expression(value, over).column
                out = F.when(t, v) if out is None else out.when(t, v)
            if e[2] is not None:
                out = out.otherwise(self.expression(e[2], over).column)
            return self.typed(out, over)
        if kind == "over":
            return self.typed(self._over(e, over), over)
        if kind == "exists":
            raise ParseError("exists stands on its own in where")
        if kind == "scalar":
            raise ParseError("a select in brackets stands for a table after from or in")
        if kind == "lambda":
            raise KindError("a function is no value here")
        raise ParseError(f"{kind} is no expression")

    def _span(self, parts: dict) -> Typed:
        months = parts.get("years", 0) * 12 + parts.get("months", 0)
        rest = {k: v for k, v in parts.items() if k not in ("years", "months")}
        if months and rest:
            raise KindError("months and days don't mix in a span")
        if months or not rest:
            return self.typed(F.make_ym_interval(F.lit(months // 12), F.lit(months % 12)))
        return self.typed(F.make_dt_interval(*[F.lit(rest.get(k, 0)) for k in ("days", "hours", "minutes")], F.lit(rest.get("seconds", 0))))

    def _list(self, items: list, over: DataFrame | None) -> Typed:
        parts = [self.expression(x, over) for x in items]
        if any(isinstance(p.kind, T.DoubleType) for p in parts):
            parts = [Typed(p.column.cast("double"), T.DoubleType()) if isinstance(p.kind, T.LongType) and not p.bound else p for p in parts]
        return self.made(lambda *ps: F.array(*[p.column for p in ps]), *parts, over=over)

    def _name(self, name: str, over: DataFrame | None) -> Typed:
        if over is not None and (name in over.columns or ("." in name and name.split(".")[-1] in over.columns)):
            return Typed.of(over, F.col(name))
        got = self.get(name)
        if isinstance(got, Typed):
            return got
        raise KindError(f"no value has the name {name}")

    def _monad(self, verb: str, v: Typed, over: DataFrame | None) -> Typed:
        rules: dict[str, Callable[[Typed], Column]] = {"-": atomic.negate, "!": lambda x: cells.lifted(lambda y: ~y.cast("boolean"), x.column, x.depth), "#": lambda x: cells.count(x.column)}
        if v.depth:
            rules |= {"*": lambda x: cells.item(x.column, 0), "|": lambda x: F.reverse(x.column), "?": lambda x: cells.as_set(x.column)}
            rules |= {"<": lambda x: grade(x.column, x.kind.elementType), ">": lambda x: grade(x.column, x.kind.elementType, True)}
        if verb == "+":
            return v
        if verb not in rules:
            raise ParseError(f"{verb} takes two values")
        return self.made(rules[verb], v, over=over)

    def _dyad(self, verb: str, a: Typed, b: Typed, over: DataFrame | None = None) -> Typed:
        plain: dict[str, Callable] = {
            "/": atomic.divide, "%": atomic.modulo, "**": atomic.power, "=": lambda x, y: x == y, "==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<>": lambda x, y: x != y,
            "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "&": F.least, "|": F.greatest,
        }
        rules: dict[str, Callable[[Typed, Typed], Column]] = {
            "+": atomic.add,
            "-": atomic.subtract,
            "*": atomic.multiply,
            "~": lambda x, y: match(x.column, y.column, x.kind) if x.depth == y.depth else F.lit(False),
            "#": lambda n, x: F.slice(x.column, F.lit(1), n.column.cast("int")),
            "_": lambda n, x: F.slice(x.column, n.column.cast("int") + 1, F.greatest(F.size(x.column) - n.column.cast("int"), F.lit(0))),
            "^": lambda x, y: cells.append(x.column, y.column),
        }
        if verb in plain:
            rules[verb] = lambda x, y: cells.lifted2(plain[verb], x.column, y.column, x.depth, y.depth)
        if verb not in rules:
            raise ParseError(f"{verb} is no verb of two values")
        return self.made(rules[verb], a, b, over=over)

    def _index(self, v: Typed, at: list[Typed], over: DataFrame | None) -> Typed:
        for i in at:
            if isinstance(v.kind, T.MapType):
                v = self.made(lambda x, k: cells.lookup_all(x.column, k.column) if k.depth else cells.lookup(x.column, k.column), v, i, over=over)
            else:
                v = self.made(lambda x, k: cells.gather(x.column, k.column, k.depth), v, i, over=over)
        return v

    def _function(self, f: tuple) -> Callable[..., Typed]:
        """A Python function of Typed values from a verb, a lambda or a name."""
        if f[0] == "verb":
            return lambda *a: self._dyad(f[1], *a) if len(a) == 2 else self._monad(f[1], a[0], None)
        if f[0] == "lambda":
            return lambda *a: self._apply(Function(f[1], f[2], self), a)
        if f[0] == "name":
            got = self.get(f[1])
            if isinstance(got, Function):
                return lambda *a: self._apply(got, a)
            if f[1].lower() in SCALARS:
                return lambda *a: self._named(f[1].lower(), list(a), None)
        raise KindError("a function is needed")

    def _apply(self, f: Function, args) -> Typed:
        if len(args) != len(f.names):
            raise CallError(f"{len(args)} arguments for {len(f.names)}")
        inner = Environment(self.spark, dict(zip(f.names, args, strict=True)) | {"self": f, "this": f}, f.env)
        try:
            return inner._block(f.body)
        except _Return as r:
            return r.value

    def _adverb(self, adverb: str, f: tuple, left: tuple | None, right: tuple, over: DataFrame | None) -> Typed:
        call = self._function(f)
        v = self.expression(right, over)
        a = self.expression(left, over) if left is not None else None
        if not isinstance(v.kind, T.ArrayType):
            raise KindError(f"{adverb} needs a vector")
        item = v.kind.elementType
        # the type of f's result, from nulls instead of data
        probe = lambda *kinds: call(*[Typed(F.lit(None).cast(k), k) for k in kinds]).kind
        two = lambda ka, kb: lambda x, y: call(Typed(x, ka, True), Typed(y, kb, True)).column

        def rule(v: Typed, *rest: Typed) -> Column:
            a = rest[0] if rest else None
            if adverb in ("fold", "unfold"):
                kind = probe(item, item) if a is None else probe(a.kind, item)
                vec = v.column.cast(T.ArrayType(kind)) if a is None else v.column
                return (cells.fold if adverb == "fold" else cells.unfold)(vec, two(kind, kind if a is None else item), None if a is None else a.column.cast(kind))
            if adverb == "mapback":
                return cells.mapback(v.column, two(item, item), a.column if a else None)
            if adverb == "mapdown" and a is None:
                return cells.mapdown(v.column, lambda x: call(Typed(x, item, True)).column)
            if a is None:
                raise CallError(f"{adverb} takes two values")
            if adverb == "mapdown":
                return cells.zipped(a.column, v.column, two(a.kind.elementType, item))
            if adverb == "mapleft":
                return cells.mapleft(a.column, v.column, lambda x, whole: call(Typed(x, a.kind.elementType, True), Typed(whole, v.kind, v.bound)).column)
            return cells.mapright(a.column, v.column, lambda whole, y: call(Typed(whole, a.kind, a.bound), Typed(y, item, True)).column)

        return self.made(rule, v, *([a] if a is not None else []), over=over)

    def _call(self, f: tuple, args: list, over: DataFrame | None) -> Typed:
        if f[0] == "name":
            name = f[1].lower()
            got = self.get(f[1])
            if isinstance(got, Function):
                return self._apply(got, [self.expression(a, over) for a in args])
            if over is not None and name in AGGREGATES:
                if args == [("star",)]:
                    return self.typed(F.count("*"), over)
                return self.typed(AGGREGATES[name](*[self.expression(a, over).column for a in args]), over)
            if name in LITERALS:
                place, f_ = LITERALS[name]
                if any(a[0] not in ("number", "string") for a in args[place : place + 1]):
                    raise CallError(f"{name} needs a literal")
                given = [a[1] if k == place else self.expression(a, over) for k, a in enumerate(args)]
                cols = [x for x in given if isinstance(x, Typed)]
                return self.made(lambda *cs: f_(*[next(it).column if isinstance(x, Typed) else x for it in [iter(cs)] for x in given]), *cols, over=over)
            return self._named(name, [self.expression(a, over) for a in args], over)
        return self._apply(Function(f[1], f[2], self), [self.expression(a, over) for a in args])

    def _named(self, name: str, args: list[Typed], over: DataFrame | None) -> Typed:
        folds = {"sum": lambda x, y: x + y, "max": F.greatest, "min": F.least}
        vectors: dict[str, Callable[..., Column]] = {"range": cells.progression, "map": cells.map_of, "count": cells.count, "len": cells.count, "last": cells.last, "find": cells.find}
        f = vectors.get(name) or SCALARS.get(name)
        if name in folds and args and args[0].depth:
            f = lambda c: cells.fold(c, folds[name])
        if f is None:
            raise KindError(f"no function has the name {name}")
        try:
            return self.made(lambda *xs: f(*[x.column for x in xs]), *args, over=over)
        except TypeError as e:
            raise CallError(f"{name}: {e}") from e

    # ----------------------------------------------------------------------- SQL

    def _source(self, source: tuple) -> DataFrame:
        return self.table(source[1]) if source[0] == "name" else self._statement(source)

    def _from(self, parts: list, late: list | None = None) -> DataFrame:
        """The joined sources.  An ``on`` belongs to the join before it; one that stands after
        later joins (or after all) serves each of them with those of its tests that it can: names
        that both sides have, or expressions whose names are known by then."""
        named = [p[1] or (p[0][1] if p[0][0] == "name" else None) for p in parts]
        tables = [self._source(p[0]).alias(n) if n else self._source(p[0]) for p, n in zip(parts, named, strict=True)]
        ons = [p[3] for p in parts]
        if late and len(parts) > 1:
            ons[-1] = [*(ons[-1] or []), *late]
        out = tables[0]
        for k in range(1, len(parts)):
            how = parts[k][2]
            on = ons[k]
            if on is None and how != "cross":  # what the next on can say here
                after = next((j for j in range(k + 1, len(parts)) if ons[j] is not None), None)
                if after is not None and all(e[0] == "name" for e in ons[after]):
                    on = ons[after]
                elif after is not None:
                    both = out.crossJoin(tables[k])
                    on = [e for e in ons[after] if self._known(e, both)]
                    ons[after] = [e for e in ons[after] if e not in on]
            kind = "inner" if how == "comma" else how
            if not on:
                if how not in ("comma", "cross"):
                    raise ParseError(f"a {how.replace('_', ' ')} join needs on")
                out = out.crossJoin(tables[k])
            elif all(e[0] == "name" for e in on):
                out = out.join(tables[k], [e[1] for e in on], kind)
            else:
                both = out.crossJoin(tables[k])  # for its columns only
                out = out.join(tables[k], reduce(lambda a, b: a & b, [self.expression(e, both).column for e in on]), kind)
        return out

    def _known(self, e: tuple, over: DataFrame) -> bool:
        """Whether an expression's names are all columns of ``over`` or bound."""
        try:
            self.expression(e, over)
        except (KindError, AnalysisException):
            return False
        return True

    def _where(self, df: DataFrame, tests: list) -> DataFrame:
        for e in [part for test in tests for part in self._conjuncts(test)]:
            inner = e[1] if e[0] == "not" else e
            if inner[0] == "in" and inner[2][0] != "list":
                df = self._in(df, inner, inner is e)
            elif inner[0] == "exists":
                df = self._exists(df, inner[1], inner is e)
            else:
                df = df.where(self.expression(e, df).column)
        return df

    def _in(self, df: DataFrame, e: tuple, wanted: bool) -> DataFrame:
        """``in`` and ``not in`` a select, by SQL's rule: beside a null in the list nothing is
        known not to be in it, and a null is not in an empty list only."""
        found = self._statement(e[2])
        key = self.expression(e[1], df).column
        other = found.select(F.col(found.columns[0]).alias("__in"))
        if wanted:
            return df.join(other, key == F.col("__in"), "left_semi")
        told = other.agg(F.count("*").alias("__n"), F.count(F.when(F.col("__in").isNull(), 1)).alias("__nulls"))
        out = df.join(other, key == F.col("__in"), "left_anti").crossJoin(F.broadcast(told))  # one row
        return out.where((F.col("__nulls") == 0) & (key.isNotNull() | (F.col("__n") == 0))).drop("__n", "__nulls")

    def _exists(self, df: DataFrame, select: tuple, wanted: bool) -> DataFrame:
        """A semi or anti join on those tests of the inner select that name columns of the
        outer tables; the others are the inner tables' own."""
        _, _, clauses = select
        if any(c in clauses for c in ("group", "having", "limit")):
            raise ParseError("exists takes from and where")
        inner = self._from(clauses["from"], clauses.get("on"))
        own, shared = [], []
        for e in clauses.get("where", []):
            for part in self._conjuncts(e):
                (own if self._known(part, inner) else shared).append(part)
        inner = self._where(inner, own)
        how = "left_semi" if wanted else "left_anti"
        if not shared:
            some = inner.select(F.lit(1).alias("__some")).limit(1)
            return df.join(F.broadcast(some), F.lit(True), how)  # one row at most
        both = df.crossJoin(inner)  # for its columns only
        return df.join(inner, reduce(lambda a, b: a & b, [self.expression(e, both).column for e in shared]), how)

    @staticmethod
    def _conjuncts(e: tuple) -> list[tuple]:
        return [*Environment._conjuncts(e[1]), *Environment._conjuncts(e[2])] if e[0] == "and" else [e]

    def _over(self, e: tuple, df: DataFrame | None) -> Column:
        """A window of a group.  Without a partition all rows meet in one task, unless
        ``_whole`` has planned it."""
        _, call, part, order, frame = e
        if df is None:
            raise ParseError("over stands in a select")
        name, args = call[1][1].lower(), call[2]
        if name in RANKS:
            given = [a[1] if a[0] == "number" and (k > 0 or name == "ntile") else self.expression(a, df).column for k, a in enumerate(args)]
            f = RANKS[name](*given)
        elif name in AGGREGATES:
            f = F.count("*") if args == [("star",)] else AGGREGATES[name](*[self.expression(a, df).column for a in args])
        else:
            raise KindError(f"{name} has no window")
        w = Window.partitionBy(*[self.expression(p, df).column for p in part])
        if order:
            w = w.orderBy(*self._keys(df, order))
        if frame:
            low = Window.unboundedPreceding if frame[1] is None else frame[1]
            high = Window.unboundedFollowing if frame[2] is None else frame[2]
            w = w.rowsBetween(low, high) if frame[0] == "rows" else w.rangeBetween(low, high)
        return f.over(w)

    def _whole(self, df: DataFrame, items: list) -> tuple[DataFrame, list]:
        """Row numbers and running sums, counts, minima and maxima over a whole table take
        two passes over range partitions; their items become columns."""
        out = []
        for k, (e, n) in enumerate(items):
            plain = e[0] == "over" and not e[2] and e[3] and e[4] in (None, ("rows", None, 0))
            name = e[1][1][1].lower() if plain else None
            as_ = f"__whole{k}"
            keys = [F.col(f"{as_}_{i}") for i in range(len(e[3]))] if plain else []
            if name == "row_number" or (name in ("sum", "count", "min", "max") and e[4] is not None and e[1][2] != [("star",)]):
                for i, (x, _) in enumerate(e[3]):
                    df = df.withColumn(f"{as_}_{i}", self.expression(x, df).column)
                order = [c.desc() if down else c.asc() for c, (_, down) in zip(keys, e[3], strict=True)]
                if name == "row_number":
                    df = ordinals(df, order, as_).withColumn(as_, (F.col(as_) + 1).cast("int"))
                else:
                    df = running(df.withColumn(f"{as_}_v", self.expression(e[1][2][0], df).column), order, f"{as_}_v", name, as_).drop(f"{as_}_v")
                df = df.drop(*[f"{as_}_{i}" for i in range(len(keys))])
                e = ("name", as_)
            out.append((e, n))
        return df, out

    @staticmethod
    def _aggregates(e) -> bool:
        if isinstance(e, tuple):
            if e and e[0] == "over":
                return False
            if e and e[0] == "call" and e[1][0] == "name" and e[1][1].lower() in AGGREGATES:
                return True
            return any(Environment._aggregates(x) for x in e[1:])
        return isinstance(e, list) and any(Environment._aggregates(x) for x in e)

    @staticmethod
    def _label(e: tuple, k: int) -> str:
        if e[0] == "name":
            return e[1].split(".")[-1]
        if e[0] == "call" and e[1][0] == "name":
            return "_".join([e[1][1].lower(), *[a[1].split(".")[-1] for a in e[2] if a[0] == "name"]])
        return f"c{k}"

    def _select(self, items: list, clauses: dict) -> DataFrame:
        if "from" not in clauses:
            raise ParseError("select needs from")
        df = self._where(self._from(clauses["from"], clauses.get("on")), clauses.get("where", []))
        groups = clauses.get("group", [])
        named = [(e, n or (None if e[0] == "star" else self._label(e, k))) for k, (e, n) in enumerate(items)] or [(("star",), None)]
        if groups or any(self._aggregates(e) for e, _ in named):
            out = self._grouped(df, named, groups, clauses.get("having", []))
        else:
            if "having" in clauses:
                raise ParseError("having needs groups")
            if any(e[0] == "over" for e, _ in named):
                columns = df.columns
                df, named = self._whole(df, named)
                if len(df.columns) > len(columns):  # a star stands for the table's own columns
                    named = [x for e, n in named for x in ([(("name", c), c) for c in columns] if e[0] == "star" else [(e, n)])]
            picked = [F.col("*") if e[0] == "star" else self.expression(e, df).column.alias(n) for e, n in named]
            order = clauses.get("order")
            if order and not clauses.get("distinct") and not all(e[0] == "name" and e[1] in [n for _, n in named] for e, _ in order) and not any(e[0] == "star" for e, _ in named):
                df = df.orderBy(*self._keys(df, order))  # by columns that are not selected
                clauses = {k: v for k, v in clauses.items() if k != "order"}
            out = df.select(*picked)
        if clauses.get("distinct"):
            out = out.distinct()
        if "order" in clauses:
            out = out.orderBy(*self._keys(out, clauses["order"]))
        if "limit" in clauses:
            n = self._python(self.expression(clauses["limit"]))
            if not isinstance(n, int) or n < 0:
                raise ParseError("limit needs a whole number")
            out = out.limit(n)
        return out

    def _grouped(self, df: DataFrame, named: list, groups: list, having: list) -> DataFrame:
        """Groups by expressions, or by rollup(..), cube(..) or grouping sets (..); ``having``
        may name results and groups, and aggregates of its own."""
        sets = None
        first = groups[0][0] if len(groups) == 1 else ("",)
        if first[0] == "sets":
            sets = first[1]
            groups = [(e, None) for e in dict.fromkeys(x for s in sets for x in s)]
        elif first[0] == "call" and first[1] in (("name", "rollup"), ("name", "cube")):
            sets, groups = first[1][1], [(e, None) for e in first[2]]
        keys = [(e, n or self._label(e, k)) for k, (e, n) in enumerate(groups)]
        by = {repr(e): n for e, n in keys}
        columns, aggs, tests = [], [], []
        for e, n in named:
            if repr(e) in by:
                columns.append(F.col(by[repr(e)]).alias(n))
            elif e[0] == "star":
                columns += [F.col(n_) for _, n_ in keys]
            else:
                c = self.expression(e, df).column
                # a bare column of a group is the vector of its values
                aggs.append((c if self._aggregates(e) else F.collect_list(c)).alias(n))
                columns.append(F.col(n))
        for k, e in enumerate(having):
            if self._aggregates(e):
                aggs.append(self.expression(e, df).column.alias(f"__having{k}"))
                tests.append(("name", f"__having{k}"))
            else:
                tests.append(e)
        group = [self.expression(e, df).column.alias(n) for e, n in keys]
        if sets is None:
            out = df.groupBy(*group).agg(*aggs) if aggs else df.select(*group).distinct()
        else:
            wide = df.select("*", *[c.alias(f"__key{k}") for k, c in enumerate(group)])
            own = [F.col(f"__key{k}") for k in range(len(group))]
            place = {repr(e): c for (e, _), c in zip(keys, own, strict=True)}
            made = wide.rollup(*own) if sets == "rollup" else wide.cube(*own) if sets == "cube" else wide.groupingSets([[place[repr(e)] for e in s] for s in sets], *own)
            out = made.agg(*(aggs or [F.count("*").alias("__rows")])).withColumnsRenamed({f"__key{k}": n for k, (_, n) in enumerate(keys)})
        for e in tests:
            out = out.where(self.expression(e, out).column)
        return out.select(*columns)

    def _keys(self, df: DataFrame, order: list) -> list[Column]:
        """The engine's total order.  Kinds that Spark sorts alike keep the plain
        column, which range partitioning and top-k use best."""
        out = []
        for e, down in order:
            t = self.expression(e, df)
            key = sort_key(t.column, t.kind) if isinstance(t.kind, (T.FloatType, T.DoubleType, T.StringType, T.ArrayType, T.MapType)) else t.column
            out.append(key.desc() if down else key.asc())
        return out

    def _rows_of(self, table: DataFrame, rest: dict) -> DataFrame:
        if "values" in rest:
            return dml.rows_like(table, [[self.expression(e).column for e in row] for row in rest["values"]])
        if "select" in rest:
            return self._statement(rest["select"])
        raise ParseError("values or a select is needed")

    def _rebind(self, name: str, df: DataFrame) -> DataFrame:
        self.set(name, df)
        return df

    def _insert(self, name: str, rest: dict) -> DataFrame:
        table = self.table(name)
        return self._rebind(name, dml.insert(table, self._rows_of(table, rest)))

    def _upsert(self, name: str, rest: dict) -> DataFrame:
        table = self.table(name)
        on = [e[1] for e in rest.get("on", [])]
        return self._rebind(name, dml.upsert(table, self._rows_of(table, rest), on))

    def _update(self, name: str, rest: dict) -> DataFrame:
        table = self.table(name)
        if "set" not in rest:
            raise ParseError("update needs set")
        return self._rebind(name, dml.update(table, {n: self.expression(e, table).column for n, e in rest["set"]}, self._all(table, rest)))

    def _delete(self, rest: dict) -> DataFrame:
        name = rest["from"][0][0][1]
        table = self.table(name)
        return self._rebind(name, dml.delete(table, self._all(table, rest)))

    def _all(self, table: DataFrame, rest: dict) -> Column | None:
        tests = [self.expression(e, table).column for e in rest.get("where", [])]
        return reduce(lambda a, b: a & b, tests) if tests else None

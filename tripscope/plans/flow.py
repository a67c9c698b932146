"""A chain of relational steps over the role relations, built as a DataFrame and also printed as SQL text.

Expressions are written once in the part of SQL both engines share; the few functions they spell differently are
written as the capitalised names below.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripscope.operators.cuts import by_each, by_each_sql
from tripscope.plans.role_sql import ROLES
from tripscope.sources import roles

# Relation name -> (reader, columns). Joined relations name each side's columns apart.
_RELATIONS: dict[str, tuple[Callable, list[str]]] = {
    "trips": (roles.trips, roles.TRIP_COLUMNS),
    "legs": (roles.legs, [*roles._LEG_BASE, *roles._LEG_DERIVED]),
    "bills": (roles.bills, [*roles._BILL_BASE, *roles._BILL_DERIVED]),
    "alerts": (roles.alerts, [*roles._ALERT_BASE, *roles._ALERT_DERIVED]),
    "feedback": (roles.feedback, [*roles._FB_BASE, *roles._FB_DERIVED]),
}

_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _args(text: str, start: int) -> tuple[list[str], int]:
    """Arguments of a call whose opening bracket is at ``start - 1``, and the index after its closing bracket."""
    depth, args, cur, i = 1, [], "", start
    while True:
        c = text[i]
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return [*args, cur.strip()], i + 1
        if c == "," and depth == 1:
            args.append(cur.strip())
            cur = ""
        else:
            cur += c
        i += 1


def _corr(x: str, y: str) -> str:
    sx, sy = f"stddev_samp(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"stddev_samp(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    return f"(covar_samp({x}, {y}) / nullif({sx} * {sy}, 0))"


# name -> (Spark form, other form); both take the argument list.
_CALLS = {
    "PCT": (lambda a: f"percentile({a[0]}, {a[1]})", lambda a: f"quantile_cont({a[0]}, {a[1]})"),
    "CORR": (lambda a: _corr(*a), lambda a: _corr(*a)),
    "ISUM": (lambda a: f"sum({a[0]})", lambda a: f"CAST(sum({a[0]}) AS BIGINT)"),
    "PAIRS": (lambda a: f"count(DISTINCT struct({', '.join(a)}))", lambda a: f"count(DISTINCT ({', '.join(a)}))"),
    "MAXBY": (lambda a: f"max_by({a[0]}, struct({', '.join(a[1:])}))", lambda a: f"arg_max({a[0]}, ({', '.join(a[1:])}))"),
    "MINBY": (lambda a: f"min_by({a[0]}, struct({', '.join(a[1:])}))", lambda a: f"arg_min({a[0]}, ({', '.join(a[1:])}))"),
    "YM": (lambda a: f"date_format({a[0]}, 'yyyy-MM')", lambda a: f"strftime({a[0]}, '%Y-%m')"),
    "WEEKDAY": (lambda a: f"weekday({a[0]})", lambda a: f"CAST(isodow({a[0]}) - 1 AS INTEGER)"),
    "WEEK": (lambda a: f"cast(date_trunc('WEEK', {a[0]}) as date)", lambda a: f"CAST(date_trunc('week', {a[0]}) AS DATE)"),
    "DAYS": (lambda a: f"datediff({a[0]}, {a[1]})", lambda a: f"date_diff('day', {a[1]}, {a[0]})"),
    "ADDDAYS": (lambda a: f"date_add({a[0]}, {a[1]})", lambda a: f"({a[0]} + {a[1]})"),
    "ADDMONTHS": (lambda a: f"add_months({a[0]}, {a[1]})", lambda a: f"CAST({a[0]} + to_months({a[1]}) AS DATE)"),
    "LISTD": (
        lambda a: f"array_join(array_sort(collect_set({a[0]})), '|')",
        lambda a: f"string_agg(DISTINCT {a[0]}, '|' ORDER BY {a[0]})",
    ),
    "IDIV": (lambda a: f"(({a[0]}) div ({a[1]}))", lambda a: f"(({a[0]}) // ({a[1]}))"),
    "RX": (lambda a: f"({a[0]} rlike {a[1]})", lambda a: f"regexp_matches({a[0]}, {a[1]})"),
    "RXR": (lambda a: f"regexp_replace({a[0]}, {a[1]}, {a[2]})", lambda a: f"regexp_replace({a[0]}, {a[1]}, {a[2]}, 'g')"),
    "R": (lambda a: f"round(cast({a[0]} as double), {a[1] if len(a) > 1 else 6})", lambda a: f"round(CAST({a[0]} AS DOUBLE), {a[1] if len(a) > 1 else 6})"),
    # Rounding for sums of differences, which can fall exactly half-way: a nudge settles such ties the same way everywhere.
    "RT": (lambda a: f"round(cast({a[0]} as double) + 0.0000001, {a[1]})", lambda a: f"round(CAST({a[0]} AS DOUBLE) + 0.0000001, {a[1]})"),
    "RATE": (lambda a: f"avg(CASE WHEN {a[0]} THEN 1 ELSE 0 END)", lambda a: f"avg(CASE WHEN {a[0]} THEN 1 ELSE 0 END)"),
    "NUM": (lambda a: f"count(CASE WHEN {a[0]} THEN 1 END)", lambda a: f"count(CASE WHEN {a[0]} THEN 1 END)"),
}
_CALL = re.compile(r"\b(" + "|".join(_CALLS) + r")\(")


def spell(text: str, side: int) -> str:
    """Expression text for Spark (0) or the other engine (1)."""
    while True:
        m = _CALL.search(text)
        if not m:
            return text
        args, end = _args(text, m.end())
        text = text[: m.start()] + _CALLS[m.group(1)][side](args) + text[end:]


@dataclass(frozen=True)
class Flow:
    """Immutable; each method returns a longer chain."""

    steps: tuple = ()

    # -- building
    def _then(self, *step) -> Flow:
        return Flow((*self.steps, step))

    def where(self, cond: str) -> Flow:
        return self._then("where", cond)

    def agg(self, dims: str | dict, **measures: str) -> Flow:
        """``dims``: space-separated names, or alias -> expression."""
        keys = dims if isinstance(dims, dict) else {d: d for d in dims.split()}
        return self._then("agg", keys, measures)

    def cols(self, names: str = "", **exprs: str) -> Flow:
        return self._then("cols", {**{n: n for n in names.split()}, **exprs})

    def plus(self, **exprs: str) -> Flow:
        return self._then("plus", exprs)

    def join(self, other: Flow, on: str, how: str = "inner") -> Flow:
        return self._then("join", other, on.split(), how)

    def union(self, other: Flow) -> Flow:
        return self._then("union", other)

    def distinct(self) -> Flow:
        return self._then("distinct")

    def via(self, spark_fn: Callable[[DataFrame], DataFrame], sql: str) -> Flow:
        """A step with its own DataFrame function; ``sql`` holds ``{src}`` for the chain so far."""
        return self._then("via", spark_fn, sql)

    # -- reading
    def _texts(self):
        for s in self.steps:
            if s[0] == "where":
                yield s[1]
            elif s[0] in ("cols", "plus"):
                yield from s[1].values()
            elif s[0] == "agg":
                yield from s[1].values()
                yield from s[2].values()
            elif s[0] == "join":
                yield from s[2]
            elif s[0] == "rel":
                yield s[2]
            elif s[0] == "via":
                yield s[2]

    def _words(self) -> set[str]:
        return {w for t in self._texts() for w in _WORD.findall(t)}

    def relations(self) -> set[str]:
        out = set()
        for s in self.steps:
            if s[0] == "rel":
                out.add(s[1])
            elif s[0] == "join":
                out |= s[1].relations()
            elif s[0] == "union":
                out |= s[1].relations()
        return out

    def dataframe(self, spark: SparkSession, sf: str, readers: dict | None = None) -> DataFrame:
        """``readers`` reads relations from elsewhere than the generated tables."""
        df: DataFrame | None = None
        words = self._words()
        for s in self.steps:
            kind = s[0]
            if kind == "rel":
                reader, columns = (readers or _RELATIONS)[s[1]]
                df = reader(spark, sf, *[c for c in columns if c in words])
            elif kind == "where":
                df = df.filter(spell(s[1], 0))
            elif kind == "agg":
                exprs = [F.expr(spell(e, 0)).alias(a) for a, e in s[2].items()]
                df = df.groupBy(*[F.expr(spell(e, 0)).alias(a) for a, e in s[1].items()])
                df = df.agg(*exprs) if exprs else df.agg(F.lit(1).alias("__one")).drop("__one")
            elif kind == "cols":
                df = df.select(*[F.expr(spell(e, 0)).alias(a) for a, e in s[1].items()])
            elif kind == "plus":
                df = df.select("*", *[F.expr(spell(e, 0)).alias(a) for a, e in s[1].items()])
            elif kind == "join":
                how = {"semi": "left_semi", "anti": "left_anti", "full": "full_outer"}.get(s[3], s[3])
                df = df.join(s[1].dataframe(spark, sf, readers), s[2], how)
            elif kind == "union":
                df = df.unionByName(s[1].dataframe(spark, sf, readers))
            elif kind == "distinct":
                df = df.distinct()
            elif kind == "via":
                df = s[1](df)
        return df

    def body(self) -> str:
        sql = ""
        for s in self.steps:
            kind = s[0]
            if kind == "rel":
                sql = f"SELECT * FROM {s[1]}"
            elif kind == "where":
                sql = f"SELECT * FROM ({sql}) WHERE {spell(s[1], 1)}"
            elif kind == "agg":
                keys = [f"{spell(e, 1)} AS {a}" for a, e in s[1].items()]
                vals = [f"{spell(e, 1)} AS {a}" for a, e in s[2].items()]
                group = " GROUP BY " + ", ".join(str(i + 1) for i in range(len(keys))) if keys else ""
                sql = f"SELECT {', '.join(keys + vals)} FROM ({sql}){group}"
            elif kind == "cols":
                sql = f"SELECT {', '.join(f'{spell(e, 1)} AS {a}' for a, e in s[1].items())} FROM ({sql})"
            elif kind == "plus":
                sql = f"SELECT *, {', '.join(f'{spell(e, 1)} AS {a}' for a, e in s[1].items())} FROM ({sql})"
            elif kind == "join":
                how = {"inner": "JOIN", "left": "LEFT JOIN", "full": "FULL JOIN", "semi": "SEMI JOIN", "anti": "ANTI JOIN"}[s[3]]
                sql = f"SELECT * FROM ({sql}) {how} ({s[1].body()}) USING ({', '.join(s[2])})"
            elif kind == "union":
                sql = f"SELECT * FROM ({sql}) UNION ALL BY NAME SELECT * FROM ({s[1].body()})"
            elif kind == "distinct":
                sql = f"SELECT DISTINCT * FROM ({sql})"
            elif kind == "via":
                sql = s[2].format(src=sql)
                if sql.startswith("WITH"):
                    sql = f"SELECT * FROM ({sql})"
        return sql

    def sql(self) -> str:
        return "WITH " + ",\n".join(ROLES[n].strip() for n in sorted(self.relations())) + "\n" + self.body()


def rel(name: str, keep: str = "") -> Flow:
    """A role relation; ``keep`` names columns no later expression mentions."""
    return Flow((("rel", name, keep),))


class FlowBook:
    """Registers flows under a name in a book."""

    def __init__(self, book) -> None:
        self.book = book
        self.flows: dict[str, Flow] = {}

    def __call__(self, name: str, flow: Flow) -> None:
        self.flows[name] = flow
        self.book.add(name, lambda spark, sf, f=flow: f.dataframe(spark, sf), flow.sql())

    def each(self, name: str, flow: Flow, dims: list[str], inputs: str, gate: int = 1, **measures: str) -> None:
        """A cut by several dimensions in one scan; ``inputs`` are the columns the measures read."""
        spark_side = {a: spell(e, 0) for a, e in measures.items()}
        other_side = {a: spell(e, 1) for a, e in measures.items()}
        flow = flow.cols(" ".join(dict.fromkeys([*dims, *inputs.split()])))
        self(name, flow.via(lambda df: by_each(df, dims, spark_side, gate), by_each_sql(dims, other_side, gate)))

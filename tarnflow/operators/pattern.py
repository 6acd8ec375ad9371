"""Row patterns: sequences of rows per key that match a regular expression over conditions.

Patterns of fixed length become ``lead`` over a window, and repetitions of one variable
become runs; both stay in Spark's own operators. For the others conditions are evaluated by
Spark as columns; each row becomes one character whose code says which conditions hold,
and the pattern a regular expression over such characters. Only these strings and the
columns that are used reach the matcher, one key at a time. Measures are put together from
their parts by Spark.
"""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.functions.dialect import quote, rewrite
from tarnflow.functions.types import parse_type

_BASE = 0x4E00  # first of a long run of ordinary characters
_NAME = re.compile(r"[A-Za-z_]\w*")
_COLUMN = r"(?:`[^`]+`|[A-Za-z_]\w*)"
_CALL = r"(FIRST|LAST|COUNT|SUM|AVG|MIN|MAX)\s*\(\s*(?:(\w+)\s*\.\s*)?(\*|" + _COLUMN + r")\s*\)"
_PART = re.compile(rf"'(?:[^']|'')*'|\b{_CALL}|(?<![\w.`])(?:(\w+)\s*\.\s*)?({_COLUMN})(?!\w|\s*[(.])", re.I)
_LOOKBACK = re.compile(r"\b(PREV|NEXT)\s*\(\s*(\w+)\s*(?:,\s*(\d+)\s*)?\)", re.I)

Relation = Callable[[dict, dict[str, list[dict]]], bool]


def compile_pattern(pattern: str, variables: list[str]) -> tuple[re.Pattern, list[str]]:
    """A regular expression over row characters and the variable of each of its groups.

    Every use of a variable is a class of the characters of rows that fulfil it.
    """
    if len(variables) > 10:
        raise ValueError("a pattern has at most 10 variables")
    classes = {}
    for k, name in enumerate(variables):
        classes[name] = "[" + "".join(chr(_BASE + mask) for mask in range(1 << len(variables)) if mask >> k & 1) + "]"
    unknown = [n for n in _NAME.findall(pattern) if n not in classes]
    if unknown:
        raise ValueError(f"pattern names {', '.join(unknown)} without variable")
    # Blanks only separate names.
    return re.compile(re.sub(r"\s+", "", _NAME.sub(lambda m: classes[m[0]], pattern))), variables


def _assignments(pattern: str) -> list[tuple[str, str]]:
    """Names with their quantifiers, in order; empty if the pattern nests groups or alternatives."""
    if re.search(r"[()|]", pattern):
        return []
    return re.findall(r"([A-Za-z_]\w*)\s*((?:[*+?]|\{\d*,?\d*\})?\??)", pattern)


def _match(rows: list[dict] | None, masks: list[int], steps: list[tuple[str, int, int, bool]], bit: dict[str, int], relations: dict[str, Relation], start: int) -> list[str] | None:
    """Variables of the rows from ``start`` on, or None; backtracks over how often each step repeats."""
    stack = [(start, (start,))]  # the row looked at, and where each step up to the present one began
    while stack:
        at, began = stack.pop()
        step = len(began) - 1
        if step == len(steps):
            if at > start:
                return [name for k, (name, *_) in enumerate(steps) for _ in range(began[k + 1] - began[k])]
            continue
        name, least, most, greedy = steps[step]
        times = at - began[-1]
        fits = times < most and at < len(masks) and masks[at] >> bit[name] & 1
        if fits and name in relations:
            bound: dict[str, list[dict]] = {}
            for k, begin in enumerate(began):
                end = began[k + 1] if k < step else at
                if end > begin:
                    bound[steps[k][0]] = bound.get(steps[k][0], []) + rows[begin:end]
            fits = bool(relations[name](rows[at], bound))
        more = [(at + 1, began)] if fits else []
        done = [(at, (*began, at))] if times >= least else []
        stack += done + more if greedy else more + done  # the last pushed is tried first
    return None


def _bounds(quantifier: str) -> tuple[int, int, bool]:
    greedy = not (len(quantifier) > 1 and quantifier.endswith("?"))
    core = quantifier if greedy else quantifier[:-1]
    if core in ("", "+", "*", "?"):
        return {"": (1, 1), "+": (1, 1 << 30), "*": (0, 1 << 30), "?": (0, 1)}[core] + (greedy,)
    low, comma, high = core.strip("{}").partition(",")
    return int(low or 0), int(high) if high else (1 << 30 if comma else int(low)), greedy


def _aggregate(function: str, column: str, chosen: list[dict]) -> object:
    """An aggregate over the rows that a variable matched."""
    if function == "COUNT":
        return len(chosen) if column == "*" else sum(r[column] is not None for r in chosen)
    if function in ("FIRST", "LAST"):
        return chosen[0 if function == "FIRST" else -1][column] if chosen else None
    values = [r[column] for r in chosen if r[column] is not None]
    if not values:
        return None
    return {"SUM": sum, "MIN": min, "MAX": max, "AVG": lambda v: float(sum(v)) / len(v)}[function](values)


Part = tuple[str, "str | None", str]


def _split_measure(text: str, columns: list[str], parts: list[Part]) -> str:
    """A measure over columns ``__m0``, ``__m1``...: its aggregates, which are added to ``parts``.

    A column outside an aggregate means its last value.
    """

    def place(found: re.Match) -> str:
        function, variable, column = (found[1].upper(), found[2], found[3]) if found[1] else ("LAST", found[4], found[5])
        name = (column or "").strip("`")
        if not column or (not found[1] and not variable and name not in columns):
            return found[0]  # quoted text, or a word of the language
        if name != "*" and name not in columns:
            raise ValueError(f"no column {name} in measure {text!r}")
        part = (function, variable, name)
        if part not in parts:
            parts.append(part)
        return f"__m{parts.index(part)}"

    return _PART.sub(place, text)


def _part_type(part: Part, schema: T.StructType) -> T.DataType:
    function, _, column = part
    if function == "COUNT":
        return T.LongType()
    of = schema[column].dataType
    if function == "AVG":
        return T.DoubleType()
    if function == "SUM":
        return T.DecimalType(38, of.scale) if isinstance(of, T.DecimalType) else T.LongType() if isinstance(of, T.IntegralType) else T.DoubleType()
    return of


def _measure(text: str, rows: list[dict], names: list[str]) -> object:
    """A measure that is one aggregate or column."""
    parts: list[Part] = []
    if _split_measure(text, sorted({c for r in rows for c in r}), parts).strip() != "__m0":
        raise ValueError(f"cannot read measure {text!r}")
    function, variable, column = parts[0]
    return _aggregate(function, column, [r for r, n in zip(rows, names, strict=True) if variable is None or n == variable])


def _others(condition: str, name: str, variables: list[str]) -> bool:
    """Whether a condition of ``name`` looks at rows of other variables or aggregates rows."""
    return any(m[1] or (m[4] and m[4] in variables and m[4] != name) for m in _PART.finditer(condition))


_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_COMBINE = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Mod: operator.mod}


def relate(condition: str, name: str) -> Relation:
    """A condition over a row and rows matched before, as a function; comparisons, arithmetic, AND, OR, NOT, IS NULL.

    ``B.c`` is the last row of B (the row itself for its own variable); aggregates such as
    ``SUM(B.c)`` take in the row itself. Comparisons with null are unknown, and unknown is no match.
    """
    pieces = re.split(r"('(?:[^']|'')*')", condition)
    for k in range(0, len(pieces), 2):
        piece = re.sub(r"<>", "!=", pieces[k].replace("`", ""))
        piece = re.sub(r"(?<![<>=!])=(?!=)", "==", piece)
        piece = re.sub(r"\bIS\s+NOT\s+NULL\b", "is not None", piece, flags=re.I)
        piece = re.sub(r"\bIS\s+NULL\b", "is None", piece, flags=re.I)
        pieces[k] = re.sub(r"\b(AND|OR|NOT)\b", lambda m: m[0].lower(), piece, flags=re.I)
    for k in range(1, len(pieces), 2):
        pieces[k] = repr(pieces[k][1:-1].replace("''", "'"))
    try:
        tree = ast.parse("".join(pieces).strip(), mode="eval").body
    except SyntaxError as error:
        raise ValueError(f"cannot read condition {condition!r}") from error

    def value(node: ast.expr, row: dict, bound: dict[str, list[dict]]) -> object:
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.Name):
            return row[node.id]
        if isinstance(node, ast.Attribute):
            return row[node.attr] if node.value.id == name else (bound[node.value.id][-1][node.attr] if bound.get(node.value.id) else None)
        if isinstance(node, ast.Call):
            of = node.args[0]
            variable, column = (of.value.id, of.attr) if isinstance(of, ast.Attribute) else (None, of.id)
            every = [r for rows in bound.values() for r in rows] if variable is None else bound.get(variable, [])
            return _aggregate(node.func.id.upper(), column, every + ([row] if variable in (None, name) else []))
        if isinstance(node, ast.BoolOp):
            found = [value(v, row, bound) for v in node.values]
            decisive = isinstance(node.op, ast.Or)
            return decisive if any(f is not None and bool(f) == decisive for f in found) else None if None in found else not decisive
        if isinstance(node, ast.UnaryOp):
            x = value(node.operand, row, bound)
            return None if x is None else (not x) if isinstance(node.op, ast.Not) else -x
        if isinstance(node, ast.Compare) and isinstance(node.ops[0], (ast.Is, ast.IsNot)):
            return (value(node.left, row, bound) is None) == isinstance(node.ops[0], ast.Is)
        if isinstance(node, ast.Compare) and len(node.ops) == 1:
            x, y = value(node.left, row, bound), value(node.comparators[0], row, bound)
            return None if x is None or y is None else _COMPARE[type(node.ops[0])](x, y)
        if isinstance(node, ast.BinOp):
            x, y = value(node.left, row, bound), value(node.right, row, bound)
            if x is None or y is None:
                return None
            if isinstance(node.op, ast.Div):
                return x / y if y else None
            return _COMBINE[type(node.op)](x, y)
        raise ValueError(f"cannot read condition {condition!r}")

    return lambda row, bound: value(tree, row, bound)


def _match_fixed(frame: DataFrame, keys: list[str], order: list[str], names: list[str], define: dict[str, str], parts: list[Part], used: list[str], after: str) -> DataFrame:
    """Matches of a sequence of single rows: ``__m`` columns beside the keys.

    Of hits that overlap, those that begin after the last row of a chosen one are chosen; see :func:`choose_apart`.
    """
    by_key = Window.partitionBy(*map(quote, keys))
    rows = by_key.orderBy(*map(quote, order))
    size = len(names)
    whole = F.struct(*[F.col(quote(c)) for c in used], F.lit(1).alias("__there"))
    placed = frame.select(*map(quote, keys), *[quote(c) for c in order if c not in keys], whole.alias("__p0"), *[F.lead(whole, k).over(rows).alias(f"__p{k}") for k in range(1, size)], F.row_number().over(rows).alias("__at"))

    def positions(variable: str | None, until: int = size - 1) -> list[int]:
        return [k for k in range(until + 1) if variable is None or names[k] == variable]

    def of(part: Part, until: int = size - 1) -> str:
        function, variable, column = part
        at = positions(variable, until)
        cells = [f"__p{k}.{quote(column)}" for k in at]
        if function == "COUNT":
            return f"CAST({len(at)} AS BIGINT)" if column == "*" else " + ".join(["0L", *[f"IF({c} IS NULL, 0, 1)" for c in cells]])
        if not cells:
            return "NULL"
        if function in ("FIRST", "LAST"):
            return cells[0 if function == "FIRST" else -1]
        if function in ("MIN", "MAX"):
            return f"array_{function.lower()}(array({', '.join(cells)}))"
        total = "(" + " + ".join(f"coalesce({c}, 0)" for c in cells) + ")"
        known = "(" + " + ".join(f"IF({c} IS NULL, 0, 1)" for c in cells) + ")"
        return f"IF({known} = 0, NULL, {total})" if function == "SUM" else f"IF({known} = 0, NULL, {total} / {known})"

    hit = F.col(f"__p{size - 1}").isNotNull()
    for k, name in enumerate(names):

        def place(found: re.Match, k: int = k, name: str = name) -> str:
            if found[1]:
                return f"({of((found[1].upper(), found[2], found[3].strip('`')), k)})"
            column = (found[5] or "").strip("`")
            if found[4] is None:
                return f"__p{k}.{quote(column)}" if column in used else found[0]
            return f"__p{k}.{quote(column)}" if found[4] == name else f"({of(('LAST', found[4], column), k)})"

        hit = hit & F.coalesce(F.expr(_PART.sub(place, define.get(name, "true"))), F.lit(False))
    hits = placed.where(hit)
    made = [F.expr(of(p)).cast(_part_type(p, frame.schema)).alias(f"__m{n}") for n, p in enumerate(parts)]
    if after != "past_last" or size == 1:
        return hits.select(*map(quote, keys), *made)
    found = hits.select(*map(quote, keys), "__at", F.struct(*made).alias("__m"))
    return choose_apart(found, keys, size).select(*map(quote, keys), "__m.*")


def choose_apart(hits: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Of hits of ``size`` rows that begin at ``__at``, those that begin after the end of the last chosen one, from the first on.

    The window brings the hits of a key together in their order and spills if they are many; then they
    pass by once, and of a key no more is remembered than where the next hit may begin.
    """
    names = list(map(quote, keys))
    ordered = hits.withColumn("__new", F.lag("__at").over(Window.partitionBy(*names).orderBy("__at")).isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free = 0
        for batch in batches:
            chosen = []
            for at, new in zip(batch.column("__at").to_pylist(), batch.column("__new").to_pylist(), strict=True):
                free = 0 if new else free
                chosen.append(at >= free)
                free = at + size if chosen[-1] else free
            yield batch.filter(pa.array(chosen, pa.bool_()))

    return ordered.mapInArrow(run, ordered.schema).drop("__new")


def _match_runs(frame: DataFrame, keys: list[str], order: list[str], step: tuple[str, int, int, bool], condition: str, parts: list[Part], used: list[str]) -> DataFrame:
    """Matches of one repeated variable: its runs, cut to the longest length that the quantifier takes."""
    name, least, most, greedy = step
    longest = most if greedy else least
    rows = Window.partitionBy(*map(quote, keys)).orderBy(*map(quote, order))
    whole = F.struct(*[F.col(quote(c)) for c in used], F.lit(1).alias("__there"))
    marked = frame.select(*map(quote, keys), whole.alias("__p"), F.coalesce(F.expr(condition), F.lit(False)).alias("__fits"), F.row_number().over(rows).alias("__at"))
    before = F.max(F.when(~F.col("__fits"), F.col("__at"))).over(Window.partitionBy(*map(quote, keys)).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumn("__run", F.coalesce(before, F.lit(0))).where("__fits")
    runs = runs.withColumn("__piece", F.floor((F.col("__at") - F.col("__run") - 1) / longest))
    made = []
    for n, (function, variable, column) in enumerate(parts):
        cell = F.lit(1) if column == "*" else F.col(f"__p.{quote(column)}")
        cell = cell if variable in (None, name) else F.lit(None).cast("long" if column == "*" else frame.schema[column].dataType)
        found = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "FIRST": lambda c: F.min_by(c, "__at"), "LAST": lambda c: F.max_by(c, "__at")}[function](cell)
        made.append(found.cast(_part_type((function, variable, column), frame.schema)).alias(f"__m{n}"))
    grouped = runs.groupBy(*map(quote, keys), "__run", "__piece").agg(F.count("*").alias("__n"), *made)
    return grouped.where(F.col("__n") >= max(1, least)).drop("__run", "__piece", "__n")


def match_rows(
    df: DataFrame,
    partition_by: list[str],
    order_by: list[str],
    pattern: str,
    define: dict[str, str | Relation],
    measures: dict[str, tuple[str, str]],
    after: str = "past_last",
) -> DataFrame:
    """One row per match: partition columns and measures.

    ``pattern`` is a sequence of variables with ``? * + {n} {n,m} {n,}`` and their reluctant
    forms; groups and alternatives are allowed when no condition relates variables.
    ``define`` gives each variable a SQL condition on its row, in which ``PREV(c)`` and
    ``NEXT(c)`` look at neighbours and ``A.c`` at the last row of another variable, or a function
    ``(row, {variable: rows}) -> bool``. Variables without definition match any row.
    ``measures`` maps an alias to an expression over ``A.c``, ``LAST(B.price)``, ``COUNT(B.*)`` or
    ``SUM(amount)`` and a type; a column without function is its last value. After a match the search goes on past its last row, or with
    ``after='next_row'`` at the row after its first.

    Sequences of single rows, whatever their conditions, and repetitions of one variable are Spark
    windows, which spill. For other patterns the rows of a key are matched in one task; a hot
    key is not split because its order matters.
    """
    variables = list(dict.fromkeys(_NAME.findall(re.sub(r"\{[^}]*\}", "", pattern))))
    order = Window.partitionBy(*[quote(c) for c in partition_by]).orderBy(*[quote(c) for c in order_by])
    compiled, _ = compile_pattern(pattern, variables)
    steps = [(n, *_bounds(q)) for n, q in _assignments(pattern)]
    parts: list[Part] = []
    formulas = {alias: _split_measure(text, df.columns, parts) for alias, (text, _) in measures.items()}
    frame, conditions = df, {}
    for name in variables:
        condition = define.get(name, "true")
        if not callable(condition):
            for kind, column, offset in _LOOKBACK.findall(condition):
                label = f"__{kind.lower()}{offset or 1}_{column}"
                if label not in frame.columns:
                    frame = frame.withColumn(label, (F.lag if kind.upper() == "PREV" else F.lead)(quote(column), int(offset or 1)).over(order))
            condition = rewrite(_LOOKBACK.sub(lambda m: f"__{m[1].lower()}{m[3] or 1}_{m[2]}", condition))
        conditions[name] = condition
    functions = {v for v, c in conditions.items() if callable(c)}
    related = {v for v, c in conditions.items() if v not in functions and _others(c, v, variables)}
    if (functions or related) and not steps:
        raise ValueError("conditions that relate variables need a pattern without groups")
    named = {w for v, c in conditions.items() if v not in functions for m in _PART.finditer(c) for w in (m[3], m[5]) if w}
    wanted = {c.strip("`") for c in named} | {c for *_, c in parts}
    used = [c for c in frame.columns if c in wanted]
    own = {v: re.sub(rf"(?<![\w.`]){v}\s*\.\s*(?=[`\w])", "", c) for v, c in conditions.items() if v not in functions and v not in related}

    def finished(matched: DataFrame) -> DataFrame:
        return matched.select(*map(quote, partition_by), *[F.expr(formulas[a]).cast(parse_type(t)).alias(a) for a, (_, t) in measures.items()])

    if steps and not functions and all(least == most for _, least, most, _ in steps) and any(least for _, least, *_ in steps):
        names = [name for name, least, *_ in steps for _ in range(least)]
        return finished(_match_fixed(frame, partition_by, order_by, names, conditions, parts, used, after))
    if len(steps) == 1 and own and after == "past_last" and (steps[0][3] or steps[0][1]):
        return finished(_match_runs(frame, partition_by, order_by, steps[0], own[steps[0][0]], parts, used))

    relations = {v: conditions[v] for v in functions} | {v: relate(conditions[v], v) for v in related}
    mask = F.lit(0)
    for k, name in enumerate(variables):
        mask = mask + F.when(F.expr(own.get(name, "true")), 1 << k).otherwise(0)
    # Functions may look at any column of a row, partition columns too.
    columns = df.columns if functions else used
    inside = {c: f"__c{k}" for k, c in enumerate(dict.fromkeys([*columns, *order_by]))}
    marked = frame.select(*[quote(c) for c in partition_by], *[F.col(quote(c)).alias(a) for c, a in inside.items()], mask.alias("__mask"))
    bit = {v: k for k, v in enumerate(variables)}
    schema = T.StructType([df.schema[c] for c in partition_by] + [T.StructField(f"__m{n}", _part_type(p, frame.schema)) for n, p in enumerate(parts)])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([inside[c] for c in order_by], kind="stable")
        masks = part["__mask"].tolist()
        signs = "".join(chr(_BASE + m) for m in masks)
        if compiled.search(signs) is None:
            return pd.DataFrame([], columns=[f.name for f in schema.fields])
        cells = {c: part[inside[c]].astype(object).where(part[inside[c]].notna(), None).tolist() for c in columns}
        rows = [dict(zip(cells, values, strict=True)) for values in zip(*cells.values(), strict=True)] if relations else None
        keys = [part[c].iloc[0] for c in partition_by]
        found, at = [], 0
        while at < len(masks):
            # The expression finds where a match can begin; the steps say which row is which variable.
            hit = compiled.search(signs, at)
            if hit is None:
                break
            at = hit.start()
            names = _match(rows, masks, steps, bit, relations, at) if steps else [None] * (hit.end() - at)
            if not names:
                at += 1
                continue
            matched = rows[at : at + len(names)] if relations else [{c: v[k] for c, v in cells.items()} for k in range(at, at + len(names))]
            made = [_aggregate(f, c, [r for r, n in zip(matched, names, strict=True) if v is None or n == v]) for f, v, c in parts]
            found.append(keys + made)
            at += len(names) if after == "past_last" else 1
        return pd.DataFrame(found, columns=[f.name for f in schema.fields], dtype=object)

    return finished(marked.groupBy(*[quote(c) for c in partition_by]).applyInPandas(run, schema))

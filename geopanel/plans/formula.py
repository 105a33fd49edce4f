"""R-style formulas as column expressions.

``y ~ a + b``, ``~ a``, a bare ``y`` (the same as ``y ~ 1``), ``-1`` or ``+ 0`` without intercept, interactions ``a:b``,
products ``a*b``, ``I(expr)``, whitelisted functions (with or without ``np.``), stateful ``standardize(x)`` and
``center(x)`` whose statistics come from the training panel, and string or ``C(x)`` covariates in treatment coding.
NULL and non-finite values pass through as NULL; no row is dropped.
"""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopanel.functions.semantics import finite, ratio, safe_ln, safe_sqrt

FUNCTIONS: dict[str, Callable[..., Column]] = {
    "log": safe_ln,
    "log10": lambda c: safe_ln(c) / math.log(10),
    "log2": lambda c: safe_ln(c) / math.log(2),
    "log1p": lambda c: safe_ln(1 + c),
    "exp": F.exp,
    "expm1": F.expm1,
    "sqrt": safe_sqrt,
    "abs": F.abs,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "tanh": F.tanh,
    "square": lambda c: c * c,
    "power": F.pow,
    "minimum": F.least,
    "maximum": F.greatest,
}
STATEFUL = ("standardize", "center")
_MODULES = {"np", "numpy", "math", "pd"}


class FormulaError(ValueError):
    """A formula that cannot be read or evaluated."""


def _split(text: str, seps: str) -> list[tuple[str, str]]:
    """(separator before, part) pieces at the top level of parentheses."""
    out, depth, start, sep = [], 0, 0, ""
    for i, ch in enumerate(text):
        depth += (ch in "([") - (ch in ")]")
        if depth < 0:
            raise FormulaError(f"unbalanced parentheses in {text!r}")
        star = ch == "*" and "*" in (text[i + 1 : i + 2], text[i - 1 : i] if i else "")
        if depth == 0 and ch in seps and not star:
            out.append((sep, text[start:i].strip()))
            start, sep = i + 1, ch
    if depth:
        raise FormulaError(f"unbalanced parentheses in {text!r}")
    return [*out, (sep, text[start:].strip())]


@dataclass(frozen=True)
class Factor:
    """One variable of a term: its text as written and as parsed."""

    text: str
    tree: ast.expr

    @property
    def columns(self) -> list[str]:
        called = {id(n.func) for n in ast.walk(self.tree) if isinstance(n, ast.Call)}
        return [n.id for n in ast.walk(self.tree) if isinstance(n, ast.Name) and id(n) not in called and n.id not in _MODULES]

    @property
    def functions(self) -> list[str]:
        return [_call_name(n) for n in ast.walk(self.tree) if isinstance(n, ast.Call)]


def _call_name(n: ast.Call) -> str:
    if isinstance(n.func, ast.Attribute):
        return n.func.attr
    if isinstance(n.func, ast.Name):
        return n.func.id
    raise FormulaError("only plain function calls are supported")


def _factor(text: str) -> Factor:
    if re.fullmatch(r"\(.*\)", text) and ("+" in text or ":" in text):
        raise FormulaError(f"write out the terms of {text!r}")
    try:
        return Factor(text, ast.parse(text, mode="eval").body)
    except SyntaxError as e:
        raise FormulaError(f"cannot read {text!r}") from e


@dataclass(frozen=True)
class Formula:
    response: Factor | None
    terms: tuple[tuple[Factor, ...], ...]
    intercept: bool
    text: str

    @property
    def columns(self) -> list[str]:
        """Source columns of the covariates, sorted."""
        return sorted({c for t in self.terms for f in t for c in f.columns})

    @property
    def response_columns(self) -> list[str]:
        return sorted(set(self.response.columns)) if self.response else []

    @property
    def transformations(self) -> dict[str, list[str]]:
        """Functions by factor, outermost first."""
        every = [f for t in self.terms for f in t] + ([self.response] if self.response else [])
        return {f.text: f.functions for f in every if f.functions}


def register(name: str, f) -> None:
    """Make a function of Columns known to formulas under a name; its results that are not finite count as missing."""
    if not name.isidentifier() or name in STATEFUL or name in ("I", "C"):
        raise FormulaError(f"{name!r} cannot name a function")
    FUNCTIONS[name] = f


def parse(text: str) -> Formula:
    if text.count("~") > 1:
        raise FormulaError(f"more than one ~ in {text!r}")
    left, tilde, right = text.partition("~")
    if not tilde:
        right = "1"
    left = left.strip()
    if len(_split(left, "+")) > 1:
        raise FormulaError("a formula has one response")
    if not left and not tilde:
        raise FormulaError("an empty formula")
    terms: list[tuple[Factor, ...]] = []
    intercept = True
    for sep, part in _split(right, "+-"):
        if not part:
            if sep == "" and not terms:
                continue
            raise FormulaError(f"an empty term in {text!r}")
        if part in ("0", "1"):
            intercept = (part == "1") == (sep != "-")
            continue
        if sep == "-":
            gone = tuple(f for _, f in _split(part, ":"))
            terms = [t for t in terms if tuple(f.text for f in t) != gone]
            continue
        factors = [[_factor(p) for _, p in _split(q, ":")] for _, q in _split(part, "*")]
        new = [tuple(f) for f in factors]
        if len(factors) > 1:  # a*b is a + b + a:b, in order of the number of factors
            new = []
            for mask in sorted(range(1, 1 << len(factors)), key=lambda m: (bin(m).count("1"), m)):
                new.append(tuple(f for k in range(len(factors)) if mask >> k & 1 for f in factors[k]))
        for t in new:
            key = {f.text for f in t}
            if all({f.text for f in u} != key for u in terms):
                terms.append(t)
    terms.sort(key=len)
    return Formula(_factor(left) if left else None, tuple(terms), intercept, text)


@dataclass(frozen=True)
class Coding:
    """What training has fixed: mean and sd of stateful terms, levels of categorical factors."""

    stats: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)


def _evaluate(tree: ast.expr, coding: Coding) -> Column:
    if isinstance(tree, ast.Constant) and isinstance(tree.value, (int, float)):
        return F.lit(float(tree.value))
    if isinstance(tree, ast.Name):
        return finite(F.col(f"`{tree.id}`"))
    if isinstance(tree, ast.UnaryOp) and isinstance(tree.op, (ast.USub, ast.UAdd)):
        v = _evaluate(tree.operand, coding)
        return -v if isinstance(tree.op, ast.USub) else v
    if isinstance(tree, ast.BinOp):
        a, b = _evaluate(tree.left, coding), _evaluate(tree.right, coding)
        ops = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: ratio(a, b), ast.Pow: lambda: F.pow(a, b)}
        if type(tree.op) in ops:
            return ops[type(tree.op)]()
    if isinstance(tree, ast.Call):
        name, args = _call_name(tree), tree.args
        if name == "I" and len(args) == 1:
            return _evaluate(args[0], coding)
        if name in STATEFUL and len(args) == 1:
            inner = _evaluate(args[0], coding)
            mean, sd = coding.stats[ast.unparse(tree)]
            if mean is None:
                return F.lit(None).cast("double")
            out = inner - F.lit(mean)
            return out if name == "center" else ratio(out, F.lit(sd))
        if name in FUNCTIONS:
            return finite(FUNCTIONS[name](*[_evaluate(a, coding) for a in args]))
        raise FormulaError(f"unknown function {name!r}")
    raise FormulaError(f"cannot evaluate {ast.unparse(tree)!r}")


def _stateful(f: Factor) -> list[ast.Call]:
    """Stateful calls, inner ones first."""
    return [n for n in ast.walk(f.tree) if isinstance(n, ast.Call) and _call_name(n) in STATEFUL][::-1]


def _category(f: Factor, strings: set[str]) -> str | None:
    if isinstance(f.tree, ast.Name) and f.tree.id in strings:
        return f.tree.id
    if isinstance(f.tree, ast.Call) and _call_name(f.tree) == "C" and len(f.tree.args) == 1 and isinstance(f.tree.args[0], ast.Name):
        return f.tree.args[0].id
    return None


def string_columns(df: DataFrame) -> set[str]:
    return {n for n, t in df.dtypes if t in ("string", "boolean") or t.startswith(("char", "varchar"))}


def check_columns(formula: Formula, df: DataFrame, response: bool = True) -> None:
    need = set(formula.columns) | (set(formula.response_columns) if response else set())
    lost = sorted(need - set(df.columns))
    if lost:
        raise FormulaError(f"columns not in the table: {', '.join(lost)}")
    if response and formula.response:
        text = sorted(set(formula.response_columns) & string_columns(df))
        if text:
            raise FormulaError(f"the response must be numeric: {', '.join(text)}")


def learn(formula: Formula, df: DataFrame) -> Coding:
    """Training statistics: one aggregation a nesting level of stateful terms, one for the levels of categories."""
    strings, coding = string_columns(df), Coding()
    every = [f for t in formula.terms for f in t] + ([formula.response] if formula.response else [])
    cats = sorted({c for f in every if (c := _category(f, strings))})
    if cats:
        row = df.agg(*[F.array_sort(F.collect_set(F.col(f"`{c}`").cast("string"))).alias(c) for c in cats]).first()
        coding = Coding({}, {c: list(row[c]) for c in cats})
    todo = list({ast.unparse(n): n for f in every for n in _stateful(f)}.items())
    while todo:
        ready = [(k, n) for k, n in todo if all(ast.unparse(m) in coding.stats for m in ast.walk(n.args[0]) if isinstance(m, ast.Call) and _call_name(m) in STATEFUL)]
        cols = []
        for i, (_, n) in enumerate(ready):
            v = _evaluate(n.args[0], coding)
            cols += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
        row = df.agg(*cols).first()
        coding = Coding(coding.stats | {k: (row[f"m{i}"], row[f"s{i}"]) for i, (k, _) in enumerate(ready)}, coding.levels)
        todo = [(k, n) for k, n in todo if k not in coding.stats]
    return coding


def design(formula: Formula, df: DataFrame, coding: Coding) -> tuple[list[tuple[str, Column]], Column | None]:
    """Named covariate columns in order, and the response column."""
    strings = string_columns(df)
    out: list[tuple[str, Column]] = [("Intercept", F.lit(1.0))] if formula.intercept else []
    full_rank = not formula.intercept  # without an intercept the first category is coded in full
    for term in formula.terms:
        parts: list[list[tuple[str, Column]]] = []
        for f in term:
            cat = _category(f, strings)
            if cat is None:
                parts.append([(f.text, _evaluate(f.tree, coding))])
                continue
            levels = coding.levels[cat]
            whole = full_rank and len(term) == 1
            c = F.col(f"`{cat}`").cast("string")
            coded = [(f"{f.text}[{v}]" if whole else f"{f.text}[T.{v}]", F.when(c.isNull(), None).when(c == v, 1.0).otherwise(0.0)) for v in (levels if whole else levels[1:])]
            full_rank = full_rank and not whole
            parts.append(coded)
        cells: list[tuple[str, Column | None]] = [("", None)]
        for p in parts:
            cells = [(f"{n}:{m}" if n else m, c if old is None else old * c) for n, old in cells for m, c in p]
        out += [(n, c) for n, c in cells if c is not None]
    y = finite(_evaluate(formula.response.tree, coding)) if formula.response else None
    return out, y

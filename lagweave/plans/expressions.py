"""Expression trees over point-in-time aggregates, compiled to columns.

A tree is compiled in two steps: its primitives, without repeats and for any number of trees
together, become window columns of one select over the union frame; the tree itself is then
a column over these.  Single precision is tracked as the arithmetic of the language has it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clipped_product, rate, safe_ratio, signed_log
from ..functions.windows import DAY_WINDOWS, FAMILIES, MOVING_WINDOWS, TIME_WINDOWS, Primitive
from ..operators.asof import event_features

CodeLists = list[list]


class Expr:
    """A node: its primitives, its column over them, its text."""

    def primitives(self, codes: CodeLists) -> list[Primitive]:
        return [p for c in self.children() for p in c.primitives(codes)]

    def children(self) -> list[Expr]:
        return [v for f in fields(self) if isinstance(v := getattr(self, f.name), Expr)]

    def column(self, codes: CodeLists) -> tuple[Column, bool]:
        """The value and whether it is single precision."""
        raise NotImplementedError

    def text(self, codes: CodeLists) -> str:
        raise NotImplementedError


class Leaf(Expr):
    kind = ""
    family_window = ""

    def primitive(self, codes: CodeLists) -> Primitive:
        where = {"moving": MOVING_WINDOWS, "time": [("time", w) for w in TIME_WINDOWS], "days": [("days", w) for w in DAY_WINDOWS]}[self.family_window]
        window_type, window = where[getattr(self, fields(self)[-1].name)]
        if hasattr(self, "category_family_i"):
            return Primitive(self.kind, window_type, window, FAMILIES[self.category_family_i], codes[self.category_family_i][self.category_code_i])
        return Primitive(self.kind, window_type, window)

    def primitives(self, codes):
        return [self.primitive(codes)]

    def column(self, codes):
        return F.col(f"`{self.primitive(codes).name}`"), False

    def text(self, codes):
        return self.primitive(codes).name


def _leaf(name: str, kind: str, family_window: str, category: bool) -> type:
    index = {"moving": "window_i", "time": "time_window_i", "days": "days_window_i"}[family_window]
    names = (["category_family_i", "category_code_i"] if category else []) + [index]
    made = type(name, (Leaf,), {"__annotations__": dict.fromkeys(names, int), "kind": kind, "family_window": family_window, "__module__": __name__})
    return dataclass(frozen=True)(made)


MeanAmount = _leaf("MeanAmount", "mean", "moving", False)
MaxAmount = _leaf("MaxAmount", "max", "moving", False)
TotalAmount = _leaf("TotalAmount", "total_amount", "moving", False)
StdAmount = _leaf("StdAmount", "std", "moving", False)
CountTotal = _leaf("CountTotal", "count_total", "time", False)
CountCategory = _leaf("CountCategory", "count_category", "moving", True)
AvgDailyCount = _leaf("AvgDailyCount", "avg_daily_count", "days", False)
AvgDailyCountCategory = _leaf("AvgDailyCountCategory", "avg_daily_count_category", "days", True)
AvgDailyAmount = _leaf("AvgDailyAmount", "avg_daily_amount", "days", False)
AvgDailyAmountCategory = _leaf("AvgDailyAmountCategory", "avg_daily_amount_category", "days", True)
AvgDailyTotalAmount = _leaf("AvgDailyTotalAmount", "avg_daily_total_amount", "days", False)


@dataclass(frozen=True)
class CategoryRate(Expr):
    """Share of a category among the transactions of a time window."""

    category_family_i: int
    category_code_i: int
    time_window_i: int

    def _parts(self, codes):
        w = TIME_WINDOWS[self.time_window_i]
        return (Primitive("count_category", "time", w, FAMILIES[self.category_family_i], codes[self.category_family_i][self.category_code_i]), Primitive("count_total", "time", w))

    def primitives(self, codes):
        return list(self._parts(codes))

    def column(self, codes):
        part, whole = (F.col(f"`{p.name}`") for p in self._parts(codes))
        return rate(part, whole), True

    def text(self, codes):
        part = self._parts(codes)[0]
        return part.name.replace("feat_count_category", "feat_category_rate", 1)


@dataclass(frozen=True)
class Binary(Expr):
    left: Expr
    right: Expr
    sign = ""

    def apply(self, a: Column, b: Column) -> Column:
        raise NotImplementedError

    def column(self, codes):
        (a, single_a), (b, single_b) = self.left.column(codes), self.right.column(codes)
        single = single_a and single_b
        return self.apply(a, b).cast("float" if single else "double"), single

    def text(self, codes):
        return f"({self.left.text(codes)} {self.sign} {self.right.text(codes)})"


class Add(Binary):
    sign = "+"

    def apply(self, a, b):
        return a + b


class Sub(Binary):
    sign = "-"

    def apply(self, a, b):
        return a - b


class Mul(Binary):
    sign = "*"

    def apply(self, a, b):
        return clipped_product(a, b)


class SafeDiv(Binary):
    sign = "/"

    def column(self, codes):
        return safe_ratio(self.left.column(codes)[0], self.right.column(codes)[0]), True


@dataclass(frozen=True)
class Log(Expr):
    value: Expr

    def column(self, codes):
        x, single = self.value.column(codes)
        return signed_log(x).cast("float" if single else "double"), single

    def text(self, codes):
        return f"signed_log({self.value.text(codes)})"


TERMINALS = (MeanAmount, MaxAmount, TotalAmount, StdAmount, CountTotal, CountCategory, AvgDailyCount, AvgDailyCountCategory, AvgDailyAmount, AvgDailyAmountCategory, AvgDailyTotalAmount, CategoryRate)
OPERATORS = (Add, Sub, Mul, SafeDiv, Log)
NODES = {n.__name__: n for n in (*TERMINALS, *OPERATORS)}


def depth(e: Expr) -> int:
    return 1 + max((depth(c) for c in e.children()), default=0)


def count_nodes(e: Expr) -> int:
    return 1 + sum(map(count_nodes, e.children()))


def dependencies(trees: Iterable[Expr], codes: CodeLists) -> dict[str, Primitive]:
    return {p.name: p for e in trees for p in e.primitives(codes)}


def to_document(e: Expr) -> dict:
    return {"type": type(e).__name__, "fields": {f.name: to_document(v) if isinstance(v := getattr(e, f.name), Expr) else v for f in fields(e)}}


def from_document(doc: dict) -> Expr:
    """Only known types with exactly their fields; numbers are whole and no booleans."""
    if not isinstance(doc, dict) or set(doc) != {"type", "fields"} or doc["type"] not in NODES or not isinstance(doc["fields"], dict):
        raise ValueError(f"not an expression: {doc!r}")
    node, values = NODES[doc["type"]], {}
    if set(doc["fields"]) != {f.name for f in fields(node)}:
        raise ValueError(f"wrong fields for {doc['type']}: {sorted(doc['fields'])}")
    for name, value in doc["fields"].items():
        if isinstance(value, dict):
            values[name] = from_document(value)
        elif isinstance(value, int) and not isinstance(value, bool) and issubclass(node, (Leaf, CategoryRate)):
            values[name] = value
        else:
            raise ValueError(f"bad value for {doc['type']}.{name}: {value!r}")
    if not issubclass(node, (Leaf, CategoryRate)) and any(not isinstance(v, Expr) for v in values.values()):
        raise ValueError(f"{doc['type']} takes expressions")
    return node(**values)


def key(e: Expr) -> str:
    """Canonical text by which equal trees are known."""
    return json.dumps(to_document(e), sort_keys=True, separators=(",", ":"))


def feature_frame(tx: DataFrame, events: DataFrame, trees: list[Expr], codes: CodeLists, keep: Iterable[str] = (), names: list[str] | None = None, source=event_features) -> DataFrame:
    """One row per event with a column ``x0``, ``x1``, ... (or ``names``) per tree; the windows of
    all trees come from one pass, or from another ``source`` such as a cache's ``features``."""
    names = names or [f"x{i}" for i in range(len(trees))]
    base = source(tx, events, dependencies(trees, codes).values(), keep)
    return base.select("id", *keep, *(e.column(codes)[0].cast("double").alias(n) for e, n in zip(trees, names, strict=True)))


def terminal_space(codes: CodeLists) -> Iterator[Expr]:
    """All leaves, in the order of their types' names and fields."""
    for node in sorted(TERMINALS, key=lambda n: n.__name__):
        last = range({"window_i": len(MOVING_WINDOWS), "time_window_i": len(TIME_WINDOWS), "days_window_i": len(DAY_WINDOWS)}[fields(node)[-1].name])
        if fields(node)[0].name == "category_family_i":
            yield from (node(f, c, w) for f, known in enumerate(codes) for c in range(len(known)) for w in last)
        else:
            yield from (node(w) for w in last)


def enumerate_trees(codes: CodeLists, max_depth: int) -> Iterator[Expr]:
    """Trees in the order of depth, then operator, then children; each once, made lazily."""
    def exactly(d: int) -> Iterator[Expr]:
        if d == 1:
            yield from terminal_space(codes)
            return
        for node in sorted(OPERATORS, key=lambda n: n.__name__):
            if node is Log:
                yield from map(Log, exactly(d - 1))
            else:
                for left_depth in range(1, d):
                    for left in exactly(left_depth):
                        for right_depth in range(1, d) if left_depth == d - 1 else (d - 1,):
                            yield from (node(left, right) for right in exactly(right_depth))
    for d in range(1, max_depth + 1):
        yield from exactly(d)


def tree_count(codes: CodeLists, max_depth: int) -> list[int]:
    """How many trees there are of each depth, without making them."""
    counts = [sum(1 for _ in terminal_space(codes))]
    while len(counts) < max_depth:
        upto, below = sum(counts), sum(counts[:-1])
        counts.append(4 * (upto * upto - below * below) + counts[-1])
    return counts

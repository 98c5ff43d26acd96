"""Generators of candidates: enumeration, random trees, genetic programming."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import fields, replace
from itertools import islice

from .archive import Member
from .expressions import OPERATORS, CodeLists, Expr, Log, depth, enumerate_trees, terminal_space

POPULATION = 50
DEPTH = 4


def random_tree(rng: random.Random, leaves: list[Expr], max_depth: int, grow: float = 0.7) -> Expr:
    if max_depth <= 1 or rng.random() > grow:
        return rng.choice(leaves)
    node = rng.choice(OPERATORS)
    return node(*(random_tree(rng, leaves, max_depth - 1, grow) for _ in fields(node)))


def subtrees(e: Expr) -> Iterator[Expr]:
    yield e
    for c in e.children():
        yield from subtrees(c)


def replaced(e: Expr, at: int, new: Expr) -> tuple[Expr, int]:
    """``e`` with its subtree number ``at`` (in the order of ``subtrees``) replaced, and what is
    left of ``at``."""
    if at == 0:
        return new, -1
    at -= 1
    for f in fields(e):
        child = getattr(e, f.name)
        if isinstance(child, Expr):
            if at < 0:
                break
            made, at = replaced(child, at, new)
            e = replace(e, **{f.name: made})
    return e, at


class Enumerative:
    """Trees in the order of the enumeration, ``size`` a generation."""

    def __init__(self, codes: CodeLists, max_depth: int = DEPTH, size: int = POPULATION):
        self.stream, self.size, self.exhausted = enumerate_trees(codes, max_depth), size, False

    def generate(self, previous: list[Member], generation: int) -> list[Expr]:
        got = list(islice(self.stream, self.size))
        self.exhausted = len(got) < self.size
        return got


class RandomTrees:
    def __init__(self, codes: CodeLists, max_depth: int = DEPTH, size: int = POPULATION, seed: int = 42):
        self.leaves, self.max_depth, self.size, self.seed, self.exhausted = list(terminal_space(codes)), max_depth, size, seed, False

    def generate(self, previous: list[Member], generation: int) -> list[Expr]:
        rng = random.Random(self.seed * 1_000_003 + generation)
        return [random_tree(rng, self.leaves, self.max_depth) for _ in range(self.size)]


class Genetic(RandomTrees):
    """Elite and new trees beside children of epsilon-lexicase parents."""

    elite, novel, crossover, mutation = 0.05, 0.05, 0.01, 0.9

    def generate(self, previous: list[Member], generation: int) -> list[Expr]:
        rng = random.Random(self.seed * 1_000_003 + generation)
        if not previous:
            return [random_tree(rng, self.leaves, self.max_depth) for _ in range(self.size)]
        n_elite, n_novel = max(1, int(self.size * self.elite)), max(1, int(self.size * self.novel))
        out = [m.expr for m in sorted(previous, key=lambda m: -m.worst)[:n_elite]]
        out += [random_tree(rng, self.leaves, self.max_depth) for _ in range(n_novel)]
        while len(out) < self.size:
            child = self.lexicase(rng, previous).expr
            if rng.random() < self.crossover:
                other = rng.choice(list(subtrees(self.lexicase(rng, previous).expr)))
                child = self._fitting(rng, child, other)
            if rng.random() < self.mutation:
                child = self._fitting(rng, child, random_tree(rng, self.leaves, 2))
            out.append(child)
        return out

    def _fitting(self, rng, tree, new):
        made, _ = replaced(tree, rng.randrange(sum(1 for _ in subtrees(tree))), new)
        return made if depth(made) <= self.max_depth else tree

    @staticmethod
    def lexicase(rng: random.Random, members: list[Member]) -> Member:
        """Objectives in random order; each keeps what is within its median deviation of the best."""
        pool = list(members)
        cases = list(range(len(members[0].objectives)))
        rng.shuffle(cases)
        for c in cases:
            sign = -1 if c == len(cases) - 1 else 1  # the last objective is a cost
            values = [sign * m.objectives[c] for m in pool]
            middle = sorted(values)[len(values) // 2]
            slack = sorted(abs(v - middle) for v in values)[len(values) // 2]
            best = max(values)
            pool = [m for m, v in zip(pool, values, strict=True) if v >= best - slack]
        return rng.choice(pool)


def unique_expressions(codes: CodeLists, n: int, max_depth: int = DEPTH, observers=()) -> list[Expr]:
    """The first ``n`` of the enumeration, without evaluation; observers see each."""
    out = []
    for e in islice(enumerate_trees(codes, max_depth), n):
        for see in observers:
            see(e)
        out.append(e)
    return out

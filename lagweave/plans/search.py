"""The search loop and its life-cycle tables."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.tables import write_csv, write_json
from .archive import ActiveSet, Archive, Member
from .expressions import Expr, dependencies, key, to_document
from .scoring import Evaluator, MaterializationError
from .strategies import Enumerative, Genetic, RandomTrees, unique_expressions

S, D, L = T.StringType(), T.DoubleType(), T.LongType()
# The columns of the life-cycle tables.
CANDIDATES = T.StructType([T.StructField(n, k) for n, k in (("Strategy", S), ("CandidateIndex", L), ("Generation", L), ("Expression", S), ("Dependencies", S), ("Split1", D), ("Split2", D), ("Split3", D),
                                                            ("MaterializationTime", D), ("ArchiveMember", T.BooleanType()), ("Status", S), ("Error", S))])
GENERATIONS = T.StructType([T.StructField(n, k) for n, k in (("Strategy", S), ("Generation", L), ("Generated", L), ("Unique", L), ("Duplicate", L), ("Invalid", L), ("Evaluated", L), ("ArchiveSize", L), ("Added", L),
                                                             ("DurationSeconds", D), ("CumulativeRuntimeSeconds", D))])
STRATEGIES = ("gp_active", "gp_without_active", "random", "enumerative")
UNBOUND = "enumerative_without_archive"  # the enumeration itself, without evaluation


@dataclass
class Search:
    """One run: promote, generate, drop repeats, evaluate the generation in one job, archive."""

    strategy: str
    evaluator: Evaluator
    generator: object
    active: ActiveSet | None = None
    archive: Archive = field(default_factory=Archive)
    candidates: list[tuple] = field(default_factory=list)
    generations: list[tuple] = field(default_factory=list)
    seen: set[str] = field(default_factory=set)

    @staticmethod
    def build(strategy: str, evaluator: Evaluator, size: int = 50, max_depth: int = 4, seed: int = 42, impute: bool = True) -> Search:
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {strategy!r}")
        if evaluator.folds != 3:
            raise ValueError("the archive needs exactly three folds")
        if strategy == "enumerative":
            generator = Enumerative(evaluator.codes, max_depth, size)
        else:
            generator = (RandomTrees if strategy == "random" else Genetic)(evaluator.codes, max_depth, size, seed)
        return Search(strategy, evaluator, generator, ActiveSet(evaluator, impute=impute) if strategy == "gp_active" else None)

    def run(self, seconds: float | None = None, generations: int | None = None, lifecycle=None) -> Archive:
        """Until the budget is spent or the generator is; generation 0 always runs.  A
        ``lifecycle`` is told of each generation when it is done."""
        begun, g, previous = time.monotonic(), 0, []
        while g == 0 or not (getattr(self.generator, "exhausted", False) or (generations is not None and g >= generations) or (seconds is not None and time.monotonic() - begun >= seconds)):
            at = len(self.candidates)
            previous = self._generation(g, previous, begun)
            if lifecycle:
                lifecycle.generation(g, self.candidates[at:], self.generations[-1], self.archive)
            g += 1
        if not self.archive.members:
            raise ValueError(f"nothing was archived: {len(self.candidates)} candidates, {sum(c[10] == 'evaluated' for c in self.candidates)} evaluated")
        return self.archive

    def _generation(self, g: int, previous: list[Member], begun: float) -> list[Member]:
        start = time.monotonic()
        if self.active and self.active.promote(g):
            self.archive.rescore(self.evaluator)
            previous = [m for m in previous if m.version == self.evaluator.version] or self.archive.members
        made: list[Expr] = self.generator.generate(previous, g)
        fresh = []
        for e in made:
            if key(e) in self.seen:
                self._record(g, e, None, "duplicate", None)
            else:
                self.seen.add(key(e))
                fresh.append(e)
        results = self.evaluator.evaluate(fresh)
        scored = [Member(e, r, self.evaluator.version) for e, r in zip(fresh, results, strict=True) if not isinstance(r, Exception)]
        added = self.archive.admit(scored)
        inside = {m.key for m in added}
        for e, r in zip(fresh, results, strict=True):
            if isinstance(r, Exception):
                self._record(g, e, None, "materialization_failed" if isinstance(r, MaterializationError) else "invalid", str(r))
            else:
                self._record(g, e, r, "evaluated", None, key(e) in inside)
        if self.active:
            self.active.admit(scored)
        now = time.monotonic()
        self.generations.append((self.strategy, g, len(made), len(fresh), len(made) - len(fresh), len(fresh) - len(scored), len(scored), len(self.archive.members), len(added), now - start, now - begun))
        elders = [m for m in previous if m.version == self.evaluator.version]
        return scored + elders[: max(0, len(made) - len(scored))] if scored else elders

    def _record(self, g, e, scores, status, error, member=False):
        needed = ";".join(sorted(dependencies([e], self.evaluator.codes)))
        splits = [float(x) for x in scores] if scores else [None] * 4
        self.candidates.append((self.strategy, len(self.candidates), g, e.text(self.evaluator.codes), needed, *splits, member, status, error))

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return spark.createDataFrame(self.candidates, CANDIDATES), spark.createDataFrame(self.generations, GENERATIONS)

    def save(self, spark: SparkSession, folder: str, mapping: dict, force: bool = False, rows: bool = True) -> None:
        """Archive and active set; with ``rows`` also the tables, unless a life cycle wrote them."""
        if rows:
            candidates, generations = self.tables(spark)
            write_csv(candidates.coalesce(1), f"{folder}/candidates", CANDIDATES, force)
            write_csv(generations.coalesce(1), f"{folder}/generations", GENERATIONS, force)
        write_json(f"{folder}/archive.json", self.archive.to_document(mapping), force)
        if self.active:
            write_json(f"{folder}/active.json", self.active.to_document(), force)


@dataclass
class Batch:
    """The first ``size`` trees of the enumeration; nothing is evaluated or archived."""

    codes: list
    size: int = 100
    max_depth: int = 4
    observers: tuple = ()
    expressions: list[Expr] = field(default_factory=list)

    def run(self, lifecycle=None) -> list[Expr]:
        begun = time.monotonic()
        self.expressions = unique_expressions(self.codes, self.size, self.max_depth, self.observers)
        took = time.monotonic() - begun
        rows = [(UNBOUND, i, 0, e.text(self.codes), ";".join(sorted(dependencies([e], self.codes))), None, None, None, None, False, "generated", None) for i, e in enumerate(self.expressions)]
        if lifecycle:
            n = len(rows)
            lifecycle.generation(0, rows, (UNBOUND, 0, n, n, 0, 0, 0, 0, 0, took, took), None)
        return self.expressions

    def save(self, folder: str) -> None:
        write_json(f"{folder}/expressions.json", [to_document(e) for e in self.expressions])

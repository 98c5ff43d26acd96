"""Permanent Pareto archive, feature history and active set."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from ..operators import selection
from .expressions import Expr, from_document, key, to_document
from .scoring import MAXIMIZE, Evaluator

QUALITY = 0.001
HISTORY_CORRELATION = 0.85
ACTIVE_CORRELATION = 0.90
MEAN_GAIN = 0.0005
EVERY = 5
SHORTLIST = 50


def dominates(a: list[float], b: list[float], maximize=MAXIMIZE) -> bool:
    signed = [(x, y) if up else (-x, -y) for x, y, up in zip(a, b, maximize, strict=True)]
    return all(x >= y for x, y in signed) and any(x > y for x, y in signed)


def front(vectors: list[list[float]], maximize=MAXIMIZE) -> list[int]:
    """Positions that nothing dominates, in order.  Vectors are those of one generation and the
    archive, on the driver."""
    ok = [i for i, v in enumerate(vectors) if all(math.isfinite(x) for x in v)]
    return [i for i in ok if not any(dominates(vectors[j], vectors[i], maximize) for j in ok)]


@dataclass
class Member:
    expr: Expr
    objectives: list[float]
    version: int = 0

    @property
    def key(self) -> str:
        return key(self.expr)

    @property
    def worst(self) -> float:
        return min(self.objectives[:-1])


@dataclass
class Archive:
    """Admits candidates on the front of members and candidates together; never drops one."""

    members: list[Member] = field(default_factory=list)

    def admit(self, candidates: list[Member]) -> list[Member]:
        known = {m.key for m in self.members}
        fresh = list({m.key: m for m in reversed(candidates) if m.key not in known}.values())[::-1]
        every = self.members + fresh
        on = set(front([m.objectives for m in every]))
        added = [m for i, m in enumerate(every) if i in on and i >= len(self.members)]
        self.members += added
        return added

    def rescore(self, evaluator: Evaluator) -> None:
        """New objectives in place; a member whose score fails keeps its last finite one."""
        for m, got in zip(self.members, evaluator.evaluate([m.expr for m in self.members]), strict=True):
            if not isinstance(got, Exception):
                m.objectives, m.version = got, evaluator.version

    def to_document(self, mapping: dict) -> dict:
        return {"format": "lagweave-archive", "version": 1, "problem": {"number_of_objectives": 4, "minimize": [not up for up in MAXIMIZE]}, "mapping": mapping,
                "expressions": [{"expression": to_document(m.expr), "objectives": m.objectives} for m in self.members]}

    @staticmethod
    def from_document(doc: dict, mapping: dict | None = None) -> Archive:
        if doc.get("format") != "lagweave-archive" or doc.get("version") != 1 or doc["problem"]["number_of_objectives"] != 4:
            raise ValueError("not an archive of this version")
        if mapping is not None and doc["mapping"] != mapping:
            raise ValueError("the archive was made with another label mapping")
        return Archive([Member(from_document(e["expression"]), [float(x) for x in e["objectives"]]) for e in doc["expressions"]])


@dataclass
class ActiveSet:
    """History of decorrelated good features, from which some are promoted into the baseline."""

    evaluator: Evaluator
    history: list[Member] = field(default_factory=list)
    events: list[dict] = field(default_factory=list)
    impute: bool = False

    def admit(self, generation: list[Member]) -> dict[str, str]:
        """Outcome by key for the members of the generation's own front."""
        outcome: dict[str, str] = {}
        chosen = []
        known = {m.key for m in self.history}
        for i in front([m.objectives for m in generation]):
            m = generation[i]
            if m.key in known or m.key in outcome:
                outcome.setdefault(m.key, "duplicate")
            elif m.worst < QUALITY:
                outcome[m.key] = "quality_threshold"
            else:
                outcome[m.key] = "candidate"
                chosen.append(m)
        if not chosen:
            return outcome
        frame = self._signals([*self.history, *chosen]).persist()
        names = [f"x{i}" for i in range(len(self.history), len(self.history) + len(chosen))]
        past = [f"x{i}" for i in range(len(self.history))]
        usable = []
        for m, name in zip(chosen, names, strict=True):
            reason = selection.usable_signal(frame, name)
            if reason:
                outcome[m.key] = f"signal_{reason}"
                continue
            held, _ = selection.first_correlated(frame, name, past, HISTORY_CORRELATION)
            if held:
                outcome[m.key] = "historical_correlation"
            else:
                usable.append((m, name))
        clusters: list[dict] = []
        for m, name in usable:
            for c in clusters:
                if selection.first_correlated(frame, name, c["names"], HISTORY_CORRELATION)[0]:
                    c["names"].append(name)
                    better = (m.worst, -m.objectives[-1]) > (c["best"].worst, -c["best"].objectives[-1])
                    outcome[(c["best"] if better else m).key] = "peer_correlation"
                    c["best"] = m if better else c["best"]
                    break
            else:
                clusters.append({"names": [name], "best": m})
        frame.unpersist()
        for c in clusters:
            outcome[c["best"].key] = "admitted"
            self.history.append(Member(c["best"].expr, list(c["best"].objectives), self.evaluator.version))
        return outcome

    def _signals(self, members: list[Member]):
        frame = self.evaluator.signals([m.expr for m in members])
        return frame.fillna(0.0) if self.impute else frame

    def promote(self, generation: int) -> list[Member]:
        """Every ``EVERY`` generations: up to two members into an empty set, one later on."""
        if generation <= 0 or generation % EVERY or not self.history:
            return []
        promoted = []
        for _ in range(1 if self.evaluator.active else 2):
            winner = self._best()
            if winner is None:
                break
            member, gains = winner
            self.evaluator.activate(member.expr)
            self.events.append({"generation": generation, "baseline_version": self.evaluator.version, "expression": to_document(member.expr), "gains": gains[:-1]})
            promoted.append(member)
        return promoted

    def _best(self) -> tuple[Member, list[float]] | None:
        active = {key(e) for e in self.evaluator.active}
        order = sorted((m for m in self.history if m.key not in active), key=lambda m: -m.worst)[:SHORTLIST]
        if not order:
            return None
        if self.evaluator.active:
            frame = self._signals([Member(e, []) for e in self.evaluator.active] + order).persist()
            refs = [f"x{i}" for i in range(len(self.evaluator.active))]
            order = [m for i, m in enumerate(order) if not selection.first_correlated(frame, f"x{len(refs) + i}", refs, ACTIVE_CORRELATION)[0]]
            frame.unpersist()
        best = None
        for m, got in zip(order, self.evaluator.evaluate([m.expr for m in order]), strict=True):
            if isinstance(got, Exception):
                continue
            gains = got[:-1]
            rank = (min(gains), sum(gains) / len(gains), -got[-1])
            if rank[0] >= 0 and rank[1] >= MEAN_GAIN and (best is None or rank > best[0]):
                best = (rank, m, got)
        return None if best is None else (best[1], best[2])

    def to_document(self) -> dict:
        return {"version": 1, "baseline_version": self.evaluator.version, "entries": [to_document(e) for e in self.evaluator.active], "promotion_events": self.events, "active_size": len(self.evaluator.active)}

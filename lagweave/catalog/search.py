"""Search strategies and final evaluation on the stand-in tables; no SQL can express them."""

from __future__ import annotations

from ..plans.final import both_reports
from ..plans.scoring import Evaluator
from ..plans.search import Search
from ..plans.expressions import CategoryRate, Log, MaxAmount, MeanAmount, SafeDiv, Sub, TotalAmount
from .history import CODES
from .inputs import event_spine, event_transactions


def _search(strategy: str, size: int, generations: int):
    def query(spark, sf_dir):
        search = Search.build(strategy, Evaluator(event_transactions(spark, sf_dir).persist(), event_spine(spark, sf_dir), CODES), size=size, max_depth=3)
        search.run(generations=generations)
        search.evaluator.close()
        return search.tables(spark)[0].drop("MaterializationTime")
    query.__name__ = f"{strategy}_run"
    return query


def _trees():
    return [MeanAmount(12), SafeDiv(MeanAmount(0), MeanAmount(17)), CategoryRate(0, 0, 3), Log(TotalAmount(15)), Sub(MaxAmount(2), MeanAmount(2))]


def final_evaluation(spark, sf_dir):
    """Forest of 500 trees and additive ensemble on the test split."""
    tx, events = event_transactions(spark, sf_dir), event_spine(spark, sf_dir)
    f, a = both_reports(tx, events, _trees(), CODES)
    return spark.createDataFrame([("forest", f["train_auc"], f["test_auc"]), ("additive", a["train_auc"], a["test_auc"])], "model string, train_auc double, test_auc double")


QUERIES = {"random_search_run": _search("random", 10, 1), "enumerative_run": _search("enumerative", 20, 2), "genetic_run": _search("gp_without_active", 10, 2), "genetic_active_run": _search("gp_active", 10, 6), "final_evaluation": final_evaluation}
ORACLES: dict = {}

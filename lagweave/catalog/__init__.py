"""Queries over the test tables, each with equivalent SQL where SQL can express it."""

from . import analysis, history, modelling, preparation, search

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (preparation, history, modelling, analysis, search):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)

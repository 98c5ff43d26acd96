"""Window descriptions, their catalogs, and feature names."""

from __future__ import annotations

from dataclasses import dataclass

HOUR = 3_600_000_000
DAY = 24 * HOUR

# Windows of the expression language.
ROW_WINDOWS = (5, 10, 20, 50, 100, 200, 400, 800, 1600)
HOUR_WINDOWS = (1, 6, 24, 168, 336, 720, 1440, 2160)
TIME_WINDOWS = (*(h * HOUR for h in HOUR_WINDOWS), -1)
DAY_WINDOWS = (7, 14, 30)
FAMILIES = ("status", "capture_method", "payment_method", "card_brand", "document_type")
MOVING_WINDOWS = (*(("row", n) for n in ROW_WINDOWS), *(("time", w) for w in TIME_WINDOWS))
KINDS = ("mean", "max", "total_amount", "std", "count_total", "count_category", "avg_daily_count", "avg_daily_count_category",
         "avg_daily_amount", "avg_daily_amount_category", "avg_daily_total_amount")
ALIASES = {"sum": "total_amount"}


# What a window's span may be, by type; and the units of a time label, largest first.
WHOLE_HISTORY = -1
TIME_UNITS = {"d": DAY, "h": HOUR, "m": HOUR // 60}


def is_span(window_type: str, window: int) -> bool:
    """Whether ``window`` counts rows, days or microseconds, or stands for the whole history."""
    if window_type not in ("row", "time", "days") or type(window) is not int:
        return False
    return window > 0 or (window_type, window) == ("time", WHOLE_HISTORY)


def window_label(window_type: str, window: int) -> str:
    """How a window is spelled in a feature's name: numbers of rows and days as they are; a time
    in the largest unit that measures it in whole numbers, or in microseconds."""
    spelled = {"total": None}
    if window_type == "time":
        spelled = {f"{window // size}{unit}": window % size for unit, size in TIME_UNITS.items()} if window != WHOLE_HISTORY else {"total": 0}
    return next((label for label, rest in spelled.items() if rest == 0), str(window))


@dataclass(frozen=True)
class Primitive:
    """A point-in-time aggregate: kind, amount column, window, and a category if it has one."""

    kind: str
    window_type: str
    window: int
    category_family: str | None = None
    category_code: int | str | None = None
    input_col: str = "amount"

    def __post_init__(self):
        if not is_span(self.window_type, self.window):
            raise ValueError(f"no window: {self.window_type} {self.window!r}")

    @property
    def name(self) -> str:
        category = [] if self.category_family is None else [self.category_family, str(self.category_code)]
        return "_".join(["feat", self.kind, *category, self.input_col, self.window_type, window_label(self.window_type, self.window)])


@dataclass(frozen=True)
class Trailing:
    """A trailing window of a row: ``rows`` of them, ``micros`` of time, or all before it."""

    rows: int | None = None
    micros: int | None = None

    def __post_init__(self):
        given = [x for x in (self.rows, self.micros) if x is not None]
        if len(given) > 1 or any(type(x) is not int or x <= 0 for x in given):
            raise ValueError("a trailing window has a positive number of rows or of microseconds, or neither")

    @property
    def mode(self) -> str:
        return "rows" if self.rows is not None else "time" if self.micros is not None else "total"

    @property
    def span(self) -> int:
        return self.rows or self.micros or 0

    @property
    def name(self) -> str:
        if self.mode == "rows":
            return f"last_{self.rows}_rows"
        if self.mode == "total":
            return "all_history"
        label = window_label("time", self.micros)
        return f"last_{label}" if label[-1] in "dh" else f"last_{self.micros}us"


TRAILING = (*(Trailing(rows=n) for n in ROW_WINDOWS), *(Trailing(micros=h * HOUR) for h in HOUR_WINDOWS), Trailing())

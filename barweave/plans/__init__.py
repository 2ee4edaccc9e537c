"""Registered query plans."""


def load() -> tuple[dict, dict]:
    from . import catalogue_backtest, catalogue_bars, catalogue_reports, catalogue_research, catalogue_signals  # noqa: F401
    from .registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)

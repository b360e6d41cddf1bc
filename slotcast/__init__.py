"""Demand analytics and weekly-ahead forecasting as Spark DataFrame functions."""

from slotcast.grid import DAILY, HOURLY, Grid

__all__ = ["DAILY", "HOURLY", "Grid"]

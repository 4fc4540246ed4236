"""Importing this module registers every query."""

from barloom.plans import bars, bonds_funds, derivatives, factors, fundamentals, indicators, linkage, portfolio, screens, signals, structures, text  # noqa: F401

"""lamella: analytics over content-addressed stores, expressed as Spark plans.

Operators take and return DataFrames; nothing below this package reads a clock,
collects a table or deletes an object unless its docstring says so.
"""

__version__ = "0.1.0"

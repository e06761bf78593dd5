"""Market-bar analytics as Spark DataFrame operators.

Tables are long: one row per (symbol, ts). Operators take and return
DataFrames, name their keys explicitly, and never pull rows to the driver.
"""

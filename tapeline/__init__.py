"""Tapeline: daily equity bars, indicators, labels and signal evaluation on Spark.

Everything is a function from DataFrame to DataFrame over long tables keyed by
(``ticker_code``, ``date``). See README.md for the data model and scale notes.
"""

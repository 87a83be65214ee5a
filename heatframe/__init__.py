"""heatframe: find, explain and predict sustained extreme events in time series.

Every function takes and returns DataFrames (or Columns); everything is lazy and
keyed by column names, so it composes with ``df.transform``.
"""

"""Labelled time series on Spark: normalise, store, and ask for ranges, series and label values."""

"""fluvion: a PySpark-native engine for panels of time series, with spatial and graph structure."""

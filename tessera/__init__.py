"""tessera: a PySpark-native engine for graph-pattern queries over many data sources."""

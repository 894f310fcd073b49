"""DataFrame -> DataFrame operators: profiling, keys, reconciliation, drift, scoring."""

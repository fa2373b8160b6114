"""attrilens: a PySpark engine for building and analysing attribution benchmarks."""

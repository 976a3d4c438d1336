"""larder: supply-chain analytics expressed as Spark DataFrame / SQL jobs.

Layout
------
sources/    table readers, fixture views over the driver tables, CSV/Parquet sinks
functions/  pure Column functions: null/tie semantics, derived columns, cleaning rules
operators/  reusable DataFrame operators: grouped reports, shares, top-k, histograms,
            box statistics, time windows, isolation forest, cross-validation folds
plans/      one module per dataset; each registers its queries with an oracle SQL twin
streaming/  Structured Streaming forms of the batch jobs
"""

__all__ = ["session"]

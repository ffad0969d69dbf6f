"""Clustering workbench on Spark DataFrames.

``sources``    readers and writers (CSV, text lines, files, ledgers, models)
``functions``  column expressions (text rules, formats, fixed values)
``operators``  DataFrame to DataFrame steps (features, clustering, profiles, ...)
``plans``      whole jobs composed of the above (cluster job, sweep, intake, ...)
``streaming``  the run ledger fold over a stream
``workload``   the registered queries and their oracle SQL
"""

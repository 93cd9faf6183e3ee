"""Recommendation analytics for retail orders, written as Spark jobs.

``sources``    reading and writing frames
``functions``  column-level helpers that stay inside one projection
``operators``  joins, aggregates, rankings and metrics: DataFrame in, DataFrame out
``plans``      whole pipelines: training set, model tuning, retail scenarios
"""

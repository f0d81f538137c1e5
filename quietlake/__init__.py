"""quietlake: privacy-preserving analytics written as Spark jobs.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and sinks), ``plans`` (query packs),
``streaming`` (incremental jobs) and, separable from the rest, ``llm``
(training-data operators).
"""

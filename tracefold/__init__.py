"""tracefold: noisy, time-stamped observations to traceable facts, on Spark.

Sub-packages: ``sources`` (readers, sinks, manifests), ``functions`` (column
expressions), ``operators`` (DataFrame to DataFrame), ``streaming`` (the same
machines on streams), ``plans`` (named queries with their SQL).  The optional
``llm`` sub-package holds the training-data operators and is imported by
nothing else here.
"""

__version__ = "0.1.0"

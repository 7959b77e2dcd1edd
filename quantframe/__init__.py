"""quantframe: portfolio research and live-record checks as Spark DataFrame operators.

Layout
------
``functions``  column helpers (money rounding, safe division, normal distribution)
``operators``  DataFrame -> DataFrame building blocks
``sources``    readers, sinks, dimensions and the derivations over the given tables
``plans``      compositions: momentum targets, NAV, parameter sweeps, strategies
``streaming``  Structured Streaming versions of the incremental operators
``catalog``    one registered query per operator with its SQL twin
"""

__version__ = "0.1.0"

"""Causal event-risk analytics as PySpark DataFrame operators.

Sub-packages
    functions   Column builders (geometry, fuzzy sets, probabilities, parsing)
    sources     schemas, file scans and sinks
    operators   DataFrame -> DataFrame operators
    plans       end-to-end query plans over the driver tables, with oracle SQL
    streaming   Structured Streaming forms of the live operators
"""

__version__ = "0.1.0"

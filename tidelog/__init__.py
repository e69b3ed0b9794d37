"""tidelog: a PySpark-native log-structured key/value and vector engine.

State is an append-only, sequence-numbered log of byte keys holding opaque
values or float32 embeddings.  Everything a caller sees -- point lookups, merges,
top-k similarity, quantization, membership filters -- is a DataFrame plan over
that log, left to Catalyst to optimise.
"""

__version__ = "0.1.0"

"""lexiflow: DataFrame operators for text-corpus analytics on Spark.

Every public operator is ``f(df, *, params) -> DataFrame``: it only builds a
lazy plan (no actions, no driver-side loops over data) so Catalyst can push
filters and prune columns across operator boundaries.
"""

__version__ = "0.1.0"

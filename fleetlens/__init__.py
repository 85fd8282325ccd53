"""fleetlens: fleet database telemetry as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` (or ``-> Column`` for
scalar expressions) that carries the snapshot key ``K`` and runs entirely on
executors with built-in Spark expressions.
"""

from fleetlens.keys import K, KEY_COLS

__all__ = ["K", "KEY_COLS"]

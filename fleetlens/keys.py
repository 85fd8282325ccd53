"""The snapshot key carried by every telemetry row.

A landed snapshot of one monitored database is addressed by the
organisation, the database (``db_key``), the logical database inside it and
the observation time.  Every global aggregate of a single-database collector
becomes ``groupBy(K)``; every ``LIMIT n`` becomes "top n per K".
"""

KEY_COLS = ("organization_id", "db_key", "logical_database_name", "observation_time")
K = list(KEY_COLS)

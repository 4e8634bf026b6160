"""tessera: a PySpark engine for operational briefings.

Ingest, clean, profile and render tables; compute business measures and
cross-table findings; build and check Markdown reports; run a caller-supplied
text generator over a column of prompts.  Everything is DataFrame / Spark SQL.
"""


def _ship_by_value() -> None:
    """Python code running on executors (mapInPandas bodies) is pickled by
    value, so executors need no installed copy of this package."""
    try:
        import sys

        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle
        pass


_ship_by_value()

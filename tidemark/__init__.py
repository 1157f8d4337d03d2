"""tidemark: market time-series analytics expressed as Spark DataFrame plans.

Sub-packages:

* ``sources``   - readers/writers: quote & instrument CSVs, fixture bars, the
                  long indicator store, catalog tables, exports.
* ``functions`` - Column builders (moving averages, deviations, performance,
                  labels), series naming, the precision-reducer transformer.
* ``operators`` - DataFrame -> DataFrame operators: hot-key-safe series
                  windows, long-form indicator operators, row-series operators
                  (EMA, performance, derivative, rate), ingestion planning.
* ``plans``     - the 69-series indicator plan, ML training / prediction,
                  report queries.
* ``streaming`` - Structured Streaming incremental quote ingestion.
"""

from tidemark.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]

"""laggard: straggler (task-skew) analytics over cluster workload traces, on Spark.

Every operator takes and returns Spark DataFrames.  Import from the
sub-packages: ``sources`` (scans and sinks), ``functions`` (column
expressions), ``operators`` (DataFrame transformations), ``plans`` (end-to-end
compositions) and ``streaming`` (live scoring).
"""

__version__ = "0.1.0"

"""loghawk: API-log anomaly analytics on Spark.

Every operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``) built from Spark SQL expressions, so Catalyst plans it and
the work is spread over the cluster.  Python runs on executors only for the
neural pieces (autoencoder gradient, reconstruction, graph attention), and
then through Arrow batches.
"""

__version__ = "0.1.0"

# Ship this package's code inside task closures (pickled by value), so Python
# workers need no installed copy and no extra files on executors.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

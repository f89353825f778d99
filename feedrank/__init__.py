"""feedrank: a Spark-native literature recommendation engine.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects.
Column expressions live in :mod:`feedrank.functions`, DataFrame operators in
:mod:`feedrank.operators`, readers in :mod:`feedrank.sources`, compositions in
:mod:`feedrank.plans` and the incremental job in :mod:`feedrank.streaming`.
"""

__version__ = "0.1.0"

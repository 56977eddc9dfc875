"""faresight: market and pricing analytics expressed as Spark DataFrame jobs.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark's
built-in expressions (and ``pyspark.ml`` for the model layer), so Catalyst
plans, prunes and pushes down the whole job and the work runs distributed.
"""

__version__ = "0.1.0"

"""Private release of tables on Spark, its audit, and operators for building training corpora."""

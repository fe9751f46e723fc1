"""Runnable jobs over the given tables; each module has run(spark, ...) and a command line."""

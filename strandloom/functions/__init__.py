"""Column functions and user-defined functions; ``register(spark)`` makes the latter callable from SQL."""

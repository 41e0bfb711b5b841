"""Station and grid analytics on Spark DataFrames.

``functions`` holds Column expressions, ``operators`` DataFrame -> DataFrame steps, ``sources`` readers and sinks,
``streaming`` the Structured Streaming forms and ``plans`` the registered queries with their SQL.
"""

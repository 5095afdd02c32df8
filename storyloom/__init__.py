"""Story intelligence over dated articles, as Spark DataFrame jobs.

``functions``  column builders (no DataFrame, no action)
``operators``  DataFrame -> DataFrame building blocks
``sources``    scans, reply ingest, state tables and sinks
``plans``      the daily jobs composed from the blocks above
``queries``    the operators wired to the driver tables, each with its SQL
"""

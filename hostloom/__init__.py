"""Hostloom: Spark DataFrame operators for building and running a website index.

``functions``  Column -> Column building blocks (text, URLs, hours, times, sites)
``sources``    table readers and versioned Parquet writers
``operators``  DataFrame -> DataFrame operators (extraction, upkeep, logs, change)
``plans``      multi-step jobs and the catalogue of registered queries
``streaming``  Structured Streaming forms of the alert and window operators
"""

__version__ = "0.1.0"

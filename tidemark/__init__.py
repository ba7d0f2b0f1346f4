"""tidemark: a Spark-native event transform and the analytics of its runs.

``operators``  DataFrame -> DataFrame: transform, latency, resources, recovery, comparison
``functions``  Column -> Column helpers, all built from Spark SQL functions
``sources``    readers and writers: Kafka, replayed files, run artifacts
``streaming``  the same transform as a micro-batch or real-time query
``plans``      the operators composed over tables: flagship plan and registered queries
"""

__version__ = "0.1.0"

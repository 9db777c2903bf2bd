"""Spark-native log analytics and anomaly detection.

Every public function takes and returns DataFrames (or Columns).  The only
values held on the driver are options, one-row statistics and the node table
of a forest, whose size depends on the options and never on the data.
"""

__version__ = "0.1.0"

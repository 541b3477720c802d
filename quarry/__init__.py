"""quarry — corpus preparation and retrieval as Spark DataFrame jobs.

Every public function takes DataFrames (or a SparkSession plus paths) and
returns a DataFrame; nothing is collected on the driver except bounded
control values (counts, quantile cut points, a size-checked question block).
"""

__version__ = "0.1.0"

"""shopflow: marketing and product analytics for web-shop data on Apache Spark.

Every analysis is a function from DataFrames to a DataFrame built only from
built-in Spark SQL expressions, so Catalyst plans it and the cluster runs it.
"""

__version__ = "0.1.0"

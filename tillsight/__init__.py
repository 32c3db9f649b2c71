"""tillsight: retail sales analytics as Spark DataFrame plans.

Sub-packages
------------
sources    where sales facts come from (CSV folders, the star schema,
           manifests, forecast and model stores)
functions  column expressions (text, numbers, dates)
operators  header mapping, cleaning, data quality, aggregates, windows
plans      features, forecasting, chart series, the query catalog
streaming  incremental ingest of a landing folder
"""

__version__ = "0.1.0"

"""polislake: civic-records processing on Spark.

Pages, listings and result files become typed tables; names become entities;
tables are merged, audited and searched. Everything takes and returns
DataFrames or Columns.
"""

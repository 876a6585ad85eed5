"""Pool analytics and corpus operators on PySpark DataFrames."""

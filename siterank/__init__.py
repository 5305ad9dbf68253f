"""Site screening, climate trend and decision-sensitivity operators on PySpark DataFrames."""

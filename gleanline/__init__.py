"""Discussion-signal analytics and training-data preparation on PySpark."""

"""Trade-compliance analytics and training-data operators as PySpark DataFrame functions."""

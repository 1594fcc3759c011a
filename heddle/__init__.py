"""A PySpark-native analytics layer over Parquet datasets."""

"""packsight: a PySpark-native engine for product-record extraction and evaluation."""

"""A PySpark-native engine for collections of scientific papers."""

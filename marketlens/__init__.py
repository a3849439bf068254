"""marketlens: a PySpark-native analytics engine for daily market price reports."""

"""hawthorn: a PySpark-native engine for rule stores, rule analytics and corpus work."""

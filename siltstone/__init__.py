"""Siltstone: a PySpark-native engine for searching and analysing multi-valued event documents."""

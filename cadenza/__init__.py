"""Cadenza: a PySpark-native analytics engine for symbolic note sequences and the tables derived from them."""

"""threadloom: a PySpark-native engine from raw news records to a queryable entity graph.

Every operator takes DataFrames and returns a lazy DataFrame; see README.md for the map of modules.
"""

__version__ = "0.1.0"

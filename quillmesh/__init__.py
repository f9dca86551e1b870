"""quillmesh: a PySpark-native engine for text collections and reader activity."""

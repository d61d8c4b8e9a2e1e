"""folioscope: a Spark-native engine for searching a document library and checking claims."""

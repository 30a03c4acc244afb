"""corvane: a PySpark-native engine for collections of semi-structured documents."""

"""rollbook: PySpark-native operators for turning public-record sources into linked, analysable tables."""

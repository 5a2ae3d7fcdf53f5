"""assetlake: a Spark-native engine for file and media catalogues."""

"""sequoria: Spark-native curation, featurisation and evaluation of labelled sequence data."""

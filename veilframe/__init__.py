"""Spark-native privacy analytics: find, score, pseudonymise and report sensitive values in text at scale."""

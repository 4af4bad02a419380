"""Spark-native engine that turns messy tables into verified deliveries."""

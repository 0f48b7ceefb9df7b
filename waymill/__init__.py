"""Spark-native engine for place registers, timetables and transit graphs."""

"""A PySpark-native engine for timed-media, task-queue and training-data tables."""

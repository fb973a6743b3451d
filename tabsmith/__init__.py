"""Spark-native workbench for tables: import, snapshots, splits, feature matrices, prediction results."""

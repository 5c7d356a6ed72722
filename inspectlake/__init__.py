"""Inspection-report analytics as Spark DataFrame operators over many projects."""

"""Exam-data analytics as composable Spark DataFrame operators."""

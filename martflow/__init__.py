"""Retail event warehouse on Spark: change logs and behaviour logs to daily reports."""

"""Screening of published summary-statistics tables, expressed as Spark plans."""

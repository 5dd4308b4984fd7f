"""Labelling, reshaping, sampling and scoring of short texts as Spark DataFrame jobs."""

"""Rare-event risk modelling over a gridded (cell, date) panel, as Spark jobs."""

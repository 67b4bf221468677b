"""Gridded earth-observation features and probability calibration as Spark DataFrame jobs."""

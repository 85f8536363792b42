"""Spark DataFrame operators for tandem mass-spectrometry data."""

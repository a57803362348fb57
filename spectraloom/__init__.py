"""Spark jobs for spectra, record tables, literature evidence and grouped validation."""

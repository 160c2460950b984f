"""Readers and writers of the planning tables, rasters and records."""

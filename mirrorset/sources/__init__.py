"""Scans, stage tables and legacy text imports."""

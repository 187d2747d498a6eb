"""Ravelin: record linkage and corpus analytics on the PySpark DataFrame API."""

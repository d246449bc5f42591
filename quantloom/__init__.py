"""Cross-sectional instrument ranking as plain PySpark DataFrame functions."""

"""Runnable jobs over Parquet tables; each has a command line and a config file."""

"""Training, search and evaluation on Spark ML."""

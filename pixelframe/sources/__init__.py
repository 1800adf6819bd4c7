"""Where images come from and go to: files, parquet tables and a generated test image."""

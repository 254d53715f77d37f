"""The analyses.  Column names and business constants are parameters throughout."""

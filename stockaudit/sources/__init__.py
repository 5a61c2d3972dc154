"""Where report inputs come from: CSV extracts, and tables derived from the test data."""

"""The reports: one parameterised function per question, DataFrames in and out."""

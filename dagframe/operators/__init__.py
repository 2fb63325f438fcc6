"""Functions from DataFrames to DataFrames; none of them runs a job."""

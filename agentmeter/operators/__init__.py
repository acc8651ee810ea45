"""Named dataset transformations, DataFrames in and DataFrames out."""

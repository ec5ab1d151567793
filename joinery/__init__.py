"""Record-linkage operators on DataFrames."""

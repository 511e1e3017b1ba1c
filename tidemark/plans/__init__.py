"""From query specifications to DataFrames."""

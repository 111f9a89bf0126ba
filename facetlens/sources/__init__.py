"""Item sets, archives and pools as DataFrames."""

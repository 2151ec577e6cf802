"""Reading tables, documents, keyspaces and dumps as DataFrames."""

"""lexquarry: document, graph and hybrid-retrieval analytics on PySpark DataFrames."""

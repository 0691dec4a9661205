"""tessera: search and governance of a document collection on PySpark."""

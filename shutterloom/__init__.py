"""Query and data-processing engine for photo collections, rosters and training corpora, on PySpark."""

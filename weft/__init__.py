"""weft: a knowledge-graph memory engine and corpus toolkit on PySpark."""

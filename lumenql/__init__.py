"""An analytics engine on PySpark: a relational and functional surface of DataFrame operators."""

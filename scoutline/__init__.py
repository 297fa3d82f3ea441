"""Active learning over large experiment spaces, as Spark DataFrame operators."""

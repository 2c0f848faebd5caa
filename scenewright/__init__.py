"""Scene question answering over layouts and object catalogs, as Spark DataFrame plans."""

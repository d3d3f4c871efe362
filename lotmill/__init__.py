"""lotmill: Spark-first analytics for nearest-neighbour inspection banks and their catalogues."""

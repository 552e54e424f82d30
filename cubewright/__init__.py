"""A semantic-model analytics engine: DAX measures compiled to Spark plans."""

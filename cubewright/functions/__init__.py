"""Functions of the language by family; ``registry`` loads them all."""

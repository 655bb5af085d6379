"""The query language and its translation to DataFrame plans."""

"""Archives of named n-dimensional arrays and ordinary tables as Spark DataFrames."""

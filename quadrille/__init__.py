"""quadrille: spatio-textual search and data preparation on Spark DataFrames."""

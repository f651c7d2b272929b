"""quillspark: full-text search, link analysis and table checks as Spark DataFrames."""

"""barloom: quantitative market analytics on whole-market tables, written as Spark jobs."""

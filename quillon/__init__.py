"""quillon: document cleaning and corpus curation on Spark DataFrames."""

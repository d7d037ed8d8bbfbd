"""quirespark: document-layout and document-text analytics on Spark DataFrames."""

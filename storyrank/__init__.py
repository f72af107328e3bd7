"""storyrank: collected items to ranked stories and reports, on Spark DataFrames."""

"""palaver: meeting-corpus analytics as Spark DataFrames."""

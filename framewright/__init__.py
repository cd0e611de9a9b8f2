"""framewright: media-timeline analytics on PySpark DataFrames."""

"""pixelframe: labelled image collections as Spark DataFrames."""

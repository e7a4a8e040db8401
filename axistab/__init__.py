"""axistab: tables whose columns are arrays over named axes, as Spark DataFrames."""

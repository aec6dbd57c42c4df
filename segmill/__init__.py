"""segmill: a segment-analytics engine written on the DataFrame and SQL API of Spark."""

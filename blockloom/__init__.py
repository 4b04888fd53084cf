"""blockloom: block volumes, their journals and snapshots as Spark DataFrames."""

"""Search, versions, metadata postings and sharding over DataFrames."""

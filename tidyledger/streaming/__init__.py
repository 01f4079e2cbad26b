"""Row-local stages over streaming DataFrames."""

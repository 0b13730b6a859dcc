"""Analytics over multimodal knowledge collections, as DataFrames."""

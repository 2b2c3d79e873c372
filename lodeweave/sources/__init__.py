"""Sources of documents, and the filters that narrow them."""

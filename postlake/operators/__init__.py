"""DataFrame to DataFrame operators of the postings pipeline and its reports."""

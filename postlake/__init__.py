"""Postings analytics on Spark: landed pages and dumps in, clean postings,
current state, ranked search and reports out."""

"""Readers: archives, state, landed API pages, listings, sitemaps, detail pages."""

"""Reading corpora, caching derived tables, writing results."""

"""Whole pipelines: scrape, crawl, map, extract, digest."""

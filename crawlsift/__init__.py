"""Crawl analytics on Spark: audits recorded pages, responses and browser events at cluster scale."""

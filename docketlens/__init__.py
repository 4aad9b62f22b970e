"""Docket analytics on Spark: outcome, attribution, indicator, statistics and entity-resolution operators."""

"""Packet analytics on Spark: typed packet tables, a filter language, search, histograms, flows and captures."""

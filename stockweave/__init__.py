"""Typed property-graph, stock-ledger and order analytics as ordinary Spark DataFrame jobs."""

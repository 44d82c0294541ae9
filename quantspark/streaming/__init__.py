"""Streams: the row-wise stages run on unbounded inputs as they are."""

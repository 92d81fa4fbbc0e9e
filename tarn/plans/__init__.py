"""Queries: operators applied to the panel that the order tables give, and the same in SQL."""

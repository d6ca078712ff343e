"""Anchor-event analytics on Spark: what follows an anchor, for whom, and how much it is worth."""

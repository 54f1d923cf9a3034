"""Imprint matching and large-scale text preparation as Spark jobs."""

"""Plan helpers: session settings, cut lineage, graph loops."""

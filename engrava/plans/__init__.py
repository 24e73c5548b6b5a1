"""Plan helpers: shared storage, lineage cuts and checked broadcasts."""

"""Plan-level helpers: lineage cuts, order-preserving dealing, fixpoint loops."""

"""A tolerant HTML tree, selectors and what is computed on trees; used inside Arrow-batched functions."""

"""Writers. Each partition of an output is replaced on its own, so a run can be repeated."""

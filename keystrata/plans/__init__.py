"""Driver routines over manifests."""

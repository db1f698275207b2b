"""Causal graph discovery: priors, independence tests, PC, FCI and DAGMA."""

"""Readers of repositories and snapshots, and the writers beside them."""

"""Whole workloads composed from the operators: single runs, sweeps, walk-forward, bootstrap."""

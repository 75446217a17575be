"""Relational views, folds, rewards, trajectories, samples and scores over multi-party discussion data, for PySpark."""

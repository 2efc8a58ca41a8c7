"""Multi-step jobs: detector runs, feature and event tables, traffic requests."""

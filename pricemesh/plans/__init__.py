"""Composed jobs: domain views over the driver tables, index build, back-test, export."""

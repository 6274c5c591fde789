"""Stream operators.

Every job of the workload is bounded batch, so no stream operator exists; the package
is where one would live.
"""

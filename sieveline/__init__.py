"""Release-diff triage on Spark."""

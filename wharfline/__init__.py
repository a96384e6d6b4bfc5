"""Partner data onboarding on Spark."""

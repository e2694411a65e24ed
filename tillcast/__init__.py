"""Customer purchase-propensity features, models and metrics on Spark."""

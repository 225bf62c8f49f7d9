"""Table operators for auditing, scoring, forecasting and ranking, on Spark."""

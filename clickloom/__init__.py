"""Click-through-rate feature engineering, learning and scoring as Spark DataFrame jobs."""

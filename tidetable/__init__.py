"""Transit reliability analytics and training-data operators on Spark."""

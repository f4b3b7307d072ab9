"""A feed analytics engine on Spark."""

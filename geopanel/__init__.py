"""geopanel: spatio-temporal panel analytics on Spark."""

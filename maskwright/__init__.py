"""Privacy transformation of tables on Spark."""

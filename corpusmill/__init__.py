"""corpusmill: text analytics and corpus preparation as DataFrame operators on Spark."""

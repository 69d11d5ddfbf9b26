"""quernflow: SQL pipelines and analytics on Spark."""

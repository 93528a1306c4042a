"""lodestone: a Spark-first engine for software-composition analytics."""

"""Document retrieval and tariff analytics as Spark DataFrame operators."""

"""Document analytics on Spark: marked-up text becomes node tables, questions over it become query plans."""

"""Media-catalog analytics on Spark: declarative DataFrame operators over large catalogs."""

"""Reading array stores: byte stores, metadata, codecs and the Spark data source."""

"""lexiloom: speech-corpus and text analytics expressed as Spark DataFrame programs."""

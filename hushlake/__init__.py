"""hushlake: finding, masking and evaluating personal data in text, as Spark DataFrames."""

"""Document structure, text fidelity and corpus operators on Spark DataFrames."""

"""Search for formulas: random generation, variation, local optimisation, islands, training."""

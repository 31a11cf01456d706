"""Column functions: text normalisation, cues, parsing and scoring."""

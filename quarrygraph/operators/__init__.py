"""Graph, history and text operators: DataFrames in, DataFrames out."""

"""Operations of large training-data pipelines, each a function from DataFrames to DataFrames."""

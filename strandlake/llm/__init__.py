"""Operations of a training-data pipeline: each takes DataFrames and returns DataFrames."""

"""Operations of a training-data pipeline on DataFrames. Nothing outside this folder imports it."""

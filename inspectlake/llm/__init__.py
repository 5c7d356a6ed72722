"""Operations of a training-data pipeline, on Spark tables of documents and embeddings."""

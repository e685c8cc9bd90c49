"""Operations of a training-data pipeline: filters, deduplication, packing and token output."""

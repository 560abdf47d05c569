"""Operations of a training-data pipeline: tokens, filters, duplicates, shards.

Nothing outside this folder imports it.
"""

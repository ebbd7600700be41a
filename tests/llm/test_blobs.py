"""op6: a flush sends a blob to each partition, so their product must not grow as the square of the text."""

from tidemark.llm import suffix_dedup as sd


def test_blobs_grow_as_the_text_does():
    def blobs(total):
        portion, flush = sd.portions(total)
        return (total / portion) * (total / flush)

    assert sd.portions(0) == sd.portions(1 << 30) == (sd.PARTITION_BYTES, sd.FLUSH_BYTES)
    assert 5.9 < blobs(6 << 30) / blobs(1 << 30) < 6.1  # 36 times as many with partitions of fixed size
    assert max(sd.portions(1 << 46)) == sd.MOST_BYTES

"""Text of attachments: pure Python extractors that run inside Arrow-batched functions."""

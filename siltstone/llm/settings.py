"""Production parameters that the queries and the pipeline share."""

from __future__ import annotations

import public_tokenizers

#: Scores from which a document counts as toxic.
TOXIC_FROM = 0.7


def tokenizer_file(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()

"""Token ids by a byte-level vocabulary."""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k"
#: Up to here both libraries read character classes alike; they hold the same vocabulary.
_UNUSUAL = re.compile("[^\x00-ɏ]").search


class Encoder:
    """Ids of texts; strings of special tokens are ordinary text, or else the tokens' ids."""

    def __init__(self, tokenizer: str, ranks: str, pattern: str, ordinary: bool = True):
        self.general = Tokenizer.from_file(tokenizer)
        self.general.encode_special_tokens = ordinary
        # Strings that only the general way reads as the tokenizer's file says.
        self.special = () if ordinary else tuple(t.content for t in self.general.get_added_tokens_decoder().values())
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        #: Above all ids.
        self.size = max(self.general.get_vocab(with_added_tokens=True).values()) + 1
        self.fast = tiktoken.Encoding("fast", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str | None, end: int) -> np.ndarray:
        """32-bit ids of a text (none for null), and an end."""
        text = text or ""
        if _UNUSUAL(text) or any(s in text for s in self.special):
            ids = self.general.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        ids.append(end)
        return np.frombuffer(array("I", ids), np.uint32)


@lru_cache(maxsize=4)
def encoder(name: str = VOCABULARY, ordinary: bool = True) -> Encoder:
    """The encoder of this process, for one of the installed byte-level vocabularies."""
    import public_tokenizers as installed

    return Encoder(installed.path(f"{name}.json"), installed.path(f"{name}.tiktoken"), installed.PATTERN, ordinary)
